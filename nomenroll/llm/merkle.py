"""Merkle manifest of a table: leaf digests, per-group subtrees, a root, and a proof for every row.

A leaf is the SHA-256 of a row's fields. The leaves of a group, ascending by key, form a binary tree: every two
consecutive nodes (the last run may hold one) become the digest of their concatenated hex digests, until one is left,
the subroot; subroots in group order form a tree of their own, whose last node is the root.

Method: nested intervals. The leaves' ranks come from one range sort and the counts of its partitions, so no window
spans a group. A node is (lo, hi, digest): the leaf ranks that it covers. Levels are taken in buckets of ``BITS``: a
block, a row of one bucket, holds at most 2**BITS consecutive nodes and all that is above them up to a single node,
which the next bucket's blocks are made of. Ancestors are attached downwards: a block joins the node of the bucket above
whose interval contains its own, in an equi-join on group and bucket key, a row per block and not per leaf. Within
a parent's interval, what a node doesn't cover is its sibling. A group of any size, one that holds a third of all rows
included, is dealt out by block.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its text. Null keys come first, rows
with equal keys ascend by leaf digest, equal rows are leaves of their own. A null group comes first. Only the named
fields are read, so extra columns never clash. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import written

#: Levels of a bucket: a block holds at most 2**BITS nodes of its lowest level, some 30 KB.
BITS = 8
#: Rows of counts (one for each range partition and group) up to which they are broadcast; joined by shuffle beyond.
BROADCAST_ROWS = 100_000
_NO_STEPS = "cast(array() as array<struct<left: boolean, digest: string>>)"


def encoded(field: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    return digest(*[encoded(f) for f in fields])


def ranked(nodes: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``nodes`` with ``lo`` (the rank in its ``grp``) and ``size`` (rows of ``grp``), by ``order`` inside a group.

    Rows are sorted by range; each counts from where its partition's part of the group begins.
    """
    rows = nodes.withColumn("__row", F.monotonically_increasing_id())  # splits equal rows over ranges
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "__row")]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    placed = written(placed.withColumn("__place", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("__range", F.shiftright("__place", 33))
    runs = placed.groupBy("grp", "__range").agg(F.min("__place").alias("__begin"), F.count("*").alias("__n"))
    runs = written(runs, f"{label}-runs")
    by_group = runs.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("__range", "__begin", "__n"))).alias("runs"))
    before = F.aggregate(  # a group has no more runs than there are ranges
        "runs",
        F.struct(F.lit(0).cast("long").alias("sum"), F.expr("cast(array() as array<struct<range: bigint, shift: bigint>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["sum"] + x["__n"]).alias("sum"),
            F.concat(acc["out"], F.array(F.struct(x["__range"].alias("range"), (acc["sum"] - x["__begin"]).alias("shift")))).alias("out"),
        ),
    )
    shifts = by_group.select("grp", before.alias("b")).select("grp", F.col("b.sum").alias("size"), F.explode("b.out").alias("x"))
    shifts = shifts.select("grp", "size", F.col("x.range").alias("__range"), F.col("x.shift").alias("__shift"))
    if runs.count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    joined = placed.join(shifts, ["grp", "__range"])
    return joined.withColumn("lo", F.col("__place") + F.col("__shift")).drop("__place", "__range", "__shift")


def height(size: Column) -> Column:
    """Levels above ``size`` nodes: the least h with 2**h >= size."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def _above(level: Column) -> Column:
    """The level over ``level``: every two consecutive nodes become one."""

    def parent(i: Column) -> Column:
        a, b = F.get(level, i * 2), F.get(level, i * 2 + 1)
        return F.struct(
            a["lo"].alias("lo"),
            F.coalesce(b["hi"], a["hi"]).alias("hi"),
            digest(a["digest"], F.coalesce(b["digest"], F.lit(""))).alias("digest"),
        )

    last = F.floor((F.size(level) + 1) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), parent)


def _step(node: Column, parent: Column, before: Column, after: Column) -> Column:
    """What folds ``node`` into its parent: the sibling covers what the node leaves of the parent's interval."""
    left, right = node["lo"] > parent["lo"], node["hi"] < parent["hi"]
    return F.struct(
        F.when(left, True).when(right, False).alias("left"),
        F.when(left, before["digest"]).when(right, after["digest"]).alias("digest"),
    )


def _paths(levels: Column, count: Column) -> Column:
    """For each node of the lowest level, its steps up to the block's single top node."""
    none = F.array(F.expr(_NO_STEPS))
    down = F.reverse(F.slice(F.array(*[F.lit(i) for i in range(BITS)]), 1, count))

    def below(paths: Column, level: Column) -> Column:
        nodes, parents = F.get(levels, level), F.get(levels, level + 1)

        def path(node: Column, i: Column) -> Column:
            up = F.floor(i / 2).cast("int")
            return F.concat(F.array(_step(node, F.get(parents, up), F.get(nodes, i - 1), F.get(nodes, i + 1))), F.get(paths, up))

        return F.transform(nodes, path)

    return F.aggregate(down, none, below)


def blocks(nodes: DataFrame, bucket: int, payload: Sequence[str], label: str) -> DataFrame:
    """grp, size, key, lo, hi, rows, paths, top: the nodes of one bucket of levels, dealt into blocks.

    ``nodes`` has grp, size, lo, hi, digest and ``payload``; the i-th of ``rows`` has its way up in the i-th of ``paths``.
    """
    key = F.shiftright("lo", BITS * (bucket + 1))
    grouped = nodes.groupBy("grp", "size", key.alias("key")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *payload))).alias("rows")
    )
    count = F.least(F.lit(BITS), F.greatest(height(F.col("size")) - BITS * bucket, F.lit(0)))
    lowest = F.transform("rows", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
    grown = F.aggregate(
        F.slice(F.array(*[F.lit(i) for i in range(BITS)]), 1, count),
        F.array(lowest),
        lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1)))),
    )
    return written(
        grouped.select("grp", "size", "key", "rows", grown.alias("levels"), count.alias("count"))
        .select("grp", "size", "key", "rows", _paths(F.col("levels"), F.col("count")).alias("paths"), F.get(F.element_at("levels", -1), F.lit(0)).alias("top"))
        .select("grp", "size", "key", F.col("top.lo").alias("lo"), F.col("top.hi").alias("hi"), F.col("top.digest").alias("top"), "rows", "paths"),
        label,
    )


_WHOLE = "hi - lo = size"  # a block whose top node covers its group


def grow(leaves: DataFrame, payload: Sequence[str], label: str) -> list[DataFrame]:
    """The blocks of each bucket of levels over ``leaves`` (grp, size, lo, digest and ``payload``), lowest first."""
    nodes = leaves.withColumn("hi", F.col("lo") + 1)
    largest = leaves.agg(F.max("size")).first()[0] or 0
    made = []
    for bucket in range(max(1, -(-max(0, largest - 1).bit_length() // BITS))):
        made.append(blocks(nodes, bucket, payload if bucket == 0 else [], f"{label}-{bucket}"))
        nodes = made[-1].filter(f"NOT ({_WHOLE})").select("grp", "size", "lo", "hi", F.col("top").alias("digest"))
    return made


def tops(made: list[DataFrame]) -> DataFrame:
    """grp, digest: the last node of each group, which one block has."""
    found = [b.filter(_WHOLE).select("grp", F.col("top").alias("digest")) for b in made]
    return reduce(DataFrame.unionByName, found)


def attach(made: list[DataFrame], above: DataFrame, payload: Sequence[str]) -> DataFrame:
    """grp, digest, payload, subroot, root and ``steps``, from the leaf up and on through ``above``.

    ``above``: grp, subroot, root, steps, a row per group: it meets the one block that covers the group. Any other
    block meets the node of the bucket above that contains it, by group and bucket key.
    """
    held = ["subroot", "root", "more"]
    groups = above.select(F.col("grp").alias("g"), "subroot", "root", F.col("steps").alias("more"))
    nodes = None
    for bucket in reversed(range(len(made))):
        own = made[bucket]
        found = own.filter(_WHOLE).join(groups, F.col("grp") == F.col("g")).select(*own.columns, *held)
        if nodes is not None:
            parents = nodes.select(F.col("grp").alias("g"), F.col("lo").alias("begin"), F.col("hi").alias("end"), "subroot", "root", F.col("steps").alias("more"))
            contained = (
                (F.col("grp") == F.col("g"))
                & (F.col("key") == F.shiftright("begin", BITS * (bucket + 1)))
                & (F.col("begin") <= F.col("lo"))
                & (F.col("hi") <= F.col("end"))
            )
            found = found.unionByName(own.filter(f"NOT ({_WHOLE})").join(parents, contained).select(*own.columns, *held))
        names = ["lo", "hi", "digest", *(payload if bucket == 0 else [])]
        each = found.select("grp", *held, F.explode(F.arrays_zip("rows", "paths")).alias("x"))
        nodes = each.select("grp", *[F.col(f"x.rows.{c}").alias(c) for c in names], "subroot", "root", F.concat("x.paths", "more").alias("steps"))
    return nodes.select("grp", "digest", *payload, "subroot", "root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its siblings make, level by level."""

    def up(node: Column, step: Column) -> Column:
        return F.when(step["left"], digest(step["digest"], node)).otherwise(digest(node, F.coalesce(step["digest"], F.lit(""))))

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, from the leaf's up; levels where a node is alone have none."""
    return digest(F.array_join(F.transform(steps, lambda s: F.coalesce(s["digest"], F.lit(""))), ""))


def manifest(rows: DataFrame, key: str, group: str, fields: Sequence[str], presented: Column | None = None) -> DataFrame:
    """key, leaf, presented, subroot, root, steps of every row; ``presented`` is the leaf digest to verify, else the row's own.

    ``steps``: array of (left: true where the sibling is the left one, false the right one, null where there is
    none; digest: the sibling's), from the leaf to the subroot and on to the root.
    """
    own = leaf_digest(*[F.col(f) for f in fields])
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp"),  # null sorts first
        F.col(key).alias("id"),
        own.alias("digest"),
        (own if presented is None else presented).alias("presented"),
    )
    leaves = written(leaves, "merkle-leaves")
    made = grow(ranked(leaves, ["id", "digest"], "merkle-order"), ["id", "presented"], "merkle")
    parts = ranked(tops(made).select(F.lit("").alias("grp"), F.col("grp").alias("part"), "digest"), ["part"], "merkle-parts")
    over = grow(parts, ["part"], "merkle-top")
    root = tops(over).select("grp", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.expr(_NO_STEPS).alias("steps"))
    above = attach(over, root, ["part"]).select(F.col("part").alias("grp"), F.col("digest").alias("subroot"), "root", "steps")
    return attach(made, above, ["id", "presented"]).select(
        F.col("id").alias(key), F.col("digest").alias("leaf"), "presented", "subroot", "root", "steps"
    )


def verified(manifest_rows: DataFrame, key: str) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root (from the presented leaf), verified."""
    return manifest_rows.select(
        key, "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("presented"), F.col("steps")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
