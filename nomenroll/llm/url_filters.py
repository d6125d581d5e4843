"""URL rules through a cascade of Bloom filters; built-in expressions only.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's. Rules are keys
``host + path``. A URL has one candidate key for each shape (number of host labels, length of path) that some rule
has, so its keys don't depend on how many rules there are. Level 0 of the cascade holds the listed keys, level 1
the keys of the corpus that level 0 takes for listed, level 2 the listed keys that level 1 takes for those, and so
on until no key errs: for the corpus's whole key universe membership is exact, and no URL is joined with the rules.

Size: with level 0 at a false-positive rate of listed / universe / sqrt(2) and the rest at one half, a cascade takes
a few bits for each listed key, however large the corpus. Rules beyond ``shard_keys`` are split by hash; each pass
over the URLs holds the filters of one shard, so what executors hold is bounded.

Null URLs and those without ``://`` have empty host and path, and no rule. Rules with a null or empty host are left
out; repeated rules count once, and a key listed for both actions blocks. Without rules everything gets the default
verdict. Longest rule: by characters of host and path. Other columns pass through; host, path, rule and verdict
replace columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import ascii_lower, written

RULES_SCHEMA = "host string, path string, action string"
ACTIONS = ("block", "allow")


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    found = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    found = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def labels_of(host: Column) -> Column:
    return F.regexp_count(host, F.lit(r"\.")) + 1


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys that a rule fitting this URL could have."""
    keys = [
        F.when(
            (host != "") & (labels_of(host) >= n) & (F.char_length(path) >= size),
            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)),
        )
        for n, size in shapes
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


class Level:
    """One Bloom filter: a table of one row that holds its words, read by a scalar subquery."""

    def __init__(self, keys: DataFrame, count: int, rate: float, seed: int):
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = max(1, math.ceil(count * self.hashes / math.log(2) / 64))
        self.seed = seed
        at = F.explode(F.array(*[self._position(F.col("key"), j) for j in range(self.hashes)]))
        bits = keys.select(at.alias("p")).select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        bits = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
        every = keys.sparkSession.range(self.words).withColumnRenamed("id", "word").join(bits, "word", "left")
        packed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
        self.name = f"__bloom_{seed}"
        self.table = written(every.agg(F.transform(packed, lambda x: x["bits"]).alias("words")), "bloom")

    def _position(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(j), key), F.lit(self.words * 64))

    def onto(self, df: DataFrame) -> DataFrame:
        """``df`` with this filter's words at hand for ``holds``."""
        return df.withColumn(self.name, self.table.select("words").scalar())

    def holds(self, key: Column) -> Column:
        words, found = F.col(self.name), F.lit(True)
        for j in range(self.hashes):
            at = self._position(key, j)
            word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
            found = found & (F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


class Cascade:
    """Exact membership of ``listed`` keys for all keys of ``universe``; both are tables of distinct ``key``."""

    def __init__(self, listed: DataFrame, universe: DataFrame, seed: int = 0):
        inside, outside = listed, written(universe.join(listed, "key", "left_anti"), "unlisted")
        count, rate = inside.count(), 0.5
        if others := outside.count():
            rate = min(0.5, max(count, 1) * math.sqrt(0.5) / others)
        self.levels: list[Level] = []
        while count:
            level = Level(inside, count, rate, seed * 1000 + len(self.levels))
            self.levels.append(level)
            wrong = written(level.onto(outside).filter(level.holds(F.col("key"))).select("key"), "errors")
            inside, outside, count, rate = wrong, inside, wrong.count(), 0.5

    def onto(self, df: DataFrame) -> DataFrame:
        for level in self.levels:
            df = level.onto(df)
        return df

    def listed(self, key: Column) -> Column:
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            verdict = F.when(self.levels[i].holds(key), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", shard_keys: int = 4_000_000) -> DataFrame:
    """``urls`` with host, path, rule (the longest that fits, else null) and verdict (its action, else ``default``).

    ``rules``: host, path, action (allow or block).
    """
    rules = rules.filter("host <> ''").select(F.concat(ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))).alias("key"), ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    rules = written(rules.groupBy("key", "host", "path").agg(F.max("action").alias("action")), "rules")
    shapes = sorted((r[0], r[1]) for r in rules.select(labels_of(F.col("host")), F.char_length("path")).distinct().collect())
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    pages = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).select(*kept, "host", "path")
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = written(pages.select(F.explode(keys).alias("key")).distinct(), "universe") if shapes else None
    shards = max(1, math.ceil(rules.count() / shard_keys))
    hits = {a: F.array().cast("array<string>") for a in ACTIONS}
    shard_of = lambda key: F.pmod(F.xxhash64(key), F.lit(shards))
    listed_in = lambda cascade, shard: lambda key: (shard_of(key) == shard) & cascade.listed(key)
    for shard in range(shards) if shapes else []:
        mine = universe.filter(shard_of(F.col("key")) == shard)
        for n, action in enumerate(ACTIONS):
            listed = written(rules.filter((F.col("action") == action) & (shard_of(F.col("key")) == shard)).select("key"), "listed")
            cascade = Cascade(listed, mine, seed=2 * shard + n)
            if cascade.levels:
                pages = cascade.onto(pages)
                hits[action] = F.concat(hits[action], F.filter(keys, listed_in(cascade, shard)))
        if shards > 1:  # the next pass holds the next shard's filters only
            pages = written(pages.select(*kept, "host", "path", *[hits[a].alias(f"__{a}") for a in ACTIONS]), "judged")
            hits = {a: F.col(f"__{a}") for a in ACTIONS}
    longest = lambda found: F.array_max(F.transform(found, lambda x: F.struct(F.char_length(x).alias("size"), x.alias("key"))))
    pages = pages.withColumns({f"__longest_{a}": longest(hits[a]) for a in ACTIONS})
    block, allow = F.col("__longest_block"), F.col("__longest_allow")
    blocked = block.isNotNull() & (allow.isNull() | (block["size"] >= allow["size"]))
    return pages.select(
        *kept,
        "host",
        "path",
        F.when(blocked, block["key"]).otherwise(allow["key"]).alias("rule"),
        F.when(blocked, F.lit("block")).when(allow.isNotNull(), F.lit("allow")).otherwise(F.lit(default)).alias("verdict"),
    )
