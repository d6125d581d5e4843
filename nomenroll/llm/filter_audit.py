"""Audit of text filters: what each removes at every place of every order, with which others, and whose fault a loss is.

A document's failures are a bit mask. All counts of an order follow from the number of documents per mask, since counts
of masks add up: a step removes the masks that hold its bit and none of an earlier one. So documents are read once for
the masks, and orders are worked out on at most 32 counts per part.

One filter is removal of repeats: a text that is identical to one with a smaller id. Its method is a counting-Bloom
prepass. Each text marks four cells of a block that its hash names; cells are counted with partial sums (a task's sketch)
and merged. A text with a cell that no other row marks is unique for certain and never moves. Only the others are grouped
by their whole text for the smallest id, and the rows with that id are recognised by (digest of the text, id), so a group
of copies that holds a third of all rows meets no single key.

Defined cases: null text is empty; a null id is never larger than another and makes nothing else a repeat; rows with equal
ids and texts don't repeat one another; a null part is the empty string and shares it. Of several labels of an id
the larger counts; a document without labels, or with null ones, counts as neither good nor toxic. Only the named columns
are read. An empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.llm.common import written

#: Cells of a block, cells that a text marks, texts meant for a block: about 0.3 % of unique texts are mistaken.
CELLS, MARKS, TEXTS = 4096, 4, 256
#: A sketch of up to so many blocks (576 bytes each, 64 MiB in all) is broadcast; beyond, rows meet their block in a join.
BROADCAST_BLOCKS = 1 << 17

#: What a filter fails, given the facts of a text.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "A": lambda f: f["words"] < 50,
    "B": lambda f: f["distinct"] * 100 < f["words"] * 65,
    "C": lambda f: f["capitals"] * 100 > f["chars"] * 5,
    "D": lambda f: f["symbols"],
}
REPEATS = "E"
STEPS = "array<struct<filter_order: string, step: int, prior: int, own: int>>"


def facts(text: Column) -> Column:
    """words, distinct (words), capitals (A-Z), chars (code points), symbols (holds one of #$%&*|)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = F.transform(
        F.array(words),  # one element, so that the words are made once
        lambda w: F.struct(
            F.size(w).cast("long").alias("words"),
            F.size(F.array_distinct(w)).cast("long").alias("distinct"),
            F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("capitals"),
            F.length(text).cast("long").alias("chars"),
            text.rlike("[#$%&*|]").alias("symbols"),
        ),
    )
    return F.get(counted, F.lit(0))


def sketch_keys(text: Column, blocks: int) -> dict[str, Column]:
    """The block of a text and its cells there, from two hashes."""
    h = F.xxhash64(text, F.lit(1))
    return {
        "block": F.pmod(F.xxhash64(text), F.lit(blocks)),
        "cells": F.array(*[F.shiftright(h, 12 * i).bitwiseAND(CELLS - 1).cast("int") for i in range(MARKS)]),
    }


def block_count(rows: int) -> int:
    """The power of two that gives a block at most ``TEXTS`` texts on average."""
    return 1 << max(0, -(-rows // TEXTS) - 1).bit_length()


def sketch(keys: DataFrame) -> DataFrame:
    """block, bits: the cells that two or more rows mark. ``keys``: block, cells.

    A row that marks one cell twice counts once for it.
    """
    marks = keys.select("block", F.explode(F.array_distinct("cells")).alias("cell"))
    counted = marks.groupBy("block", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    longs = counted.groupBy("block", F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cell & 63)")).alias("bits")
    )
    found = longs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(CELLS // 64 - 1)), lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long")))
    return found.select("block", bits.alias("bits"))


def possible_repeats(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (with block, cells) whose cells are all marked by others too; the rest are unique for certain."""
    word = lambda c: F.element_at("bits", F.shiftright(c, 6) + 1)
    all_marked = F.forall("cells", lambda c: F.getbit(word(c), c.bitwiseAND(63)) == 1)
    return rows.join(repeated, "block").filter(all_marked).drop("bits")


def masks(
    docs: DataFrame,
    labels: DataFrame,
    part: str = "source",
    checks: Mapping[str, Callable[[Column], Column]] = CHECKS,
    repeats: str = REPEATS,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_blocks: int = BROADCAST_BLOCKS,
) -> DataFrame:
    """part, mask, n, good, toxic: documents per set of failed filters; bit i is the i-th letter of ``checks``, then ``repeats``."""
    named = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    blocks = block_count(docs.count())
    keys = sketch_keys(F.col("text"), blocks)
    flat = named.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(n) for n, c in keys.items()], facts(F.col("text")).alias("f"))
    mask = F.lit(0)
    for bit, check in enumerate(checks.values()):
        mask = mask + F.when(check(F.col("f")), 1 << bit).otherwise(0)
    flags = written(flat.select("id", "part", "digest", "block", "cells", mask.alias("mask")), "audit-flags")

    repeated = written(sketch(flags), "audit-sketch")
    if blocks <= broadcast_blocks:
        repeated = F.broadcast(repeated)
    texts = named.filter("id IS NOT NULL").select("id", "text", *[c.alias(n) for n, c in keys.items()])
    smallest = possible_repeats(texts, repeated).groupBy("text").agg(F.min("id").alias("first"))
    firsts = written(smallest.select(F.unhex(F.sha2("text", 256)).alias("d"), "first"), "audit-firsts")
    suspects = possible_repeats(flags.filter("id IS NOT NULL"), repeated).select("id", "part", "digest", "mask")
    again = suspects.join(firsts, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")), "left_anti")
    bit = 1 << len(checks)

    graded = labels.groupBy(F.col(doc_id).alias("l")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).filter("quality = 1 OR toxic = 1")

    def counts(rows: DataFrame) -> DataFrame:
        marked = rows.join(graded, F.col("id") == F.col("l"), "left")
        one = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias("good" if c == "quality" else "toxic")
        return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), one("quality"), one("toxic"))

    # counts add up: repeats count for their mask with the bit, and are taken off the one without
    everything = counts(flags.select("id", "part", "mask"))
    extra = counts(again.select("id", "part", "mask"))
    sums = ["n", "good", "toxic"]
    less = extra.select("part", "mask", *[(-F.col(c)).alias(c) for c in sums])
    more = extra.select("part", (F.col("mask") + bit).alias("mask"), *sums)
    return everything.unionByName(less).unionByName(more).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, from documents per mask; zeros included."""
    size, bits = 1 << len(letters), {x: 1 << i for i, x in enumerate(letters)}
    steps = [
        {"filter_order": "".join(order), "step": step + 1, "prior": sum(bits[x] for x in order[:step]), "own": bits[letter]}
        for order in permutations(letters)
        for step, letter in enumerate(order)
    ]
    found = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("found"))
    cell = lambda m: F.element_at("found", m)
    zero = F.lit(0).cast("long")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda m: F.struct(m.alias("m"), *[F.coalesce(cell(m)[c], zero).alias(c) for c in ("n", "good", "toxic")]),
    )
    rows = found.select("part", cells.alias("cells")).select("part", "cells", F.explode(F.from_json(F.lit(json.dumps(steps)), STEPS)).alias("s")).select("part", "cells", "s.*")
    prior, own = F.col("prior"), F.col("own")

    def total(what: str, fits: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", zero, lambda sum_, x: sum_ + F.when(fits(x["m"]), x[what]).otherwise(zero))

    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(prior) != 0
    orders = 1
    for k in range(2, len(letters) + 1):
        orders *= k
    # of the orders of all filters, a document is removed by each of the filters that it fails equally often
    share = F.aggregate("cells", zero, lambda sum_, x: sum_ + F.when(fails(x["m"]), x["n"] * F.floor(F.lit(orders) / F.bit_count(x["m"]))).otherwise(zero))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(prior.bitwiseOR(own)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """All orders of the filters A to E over ``docs``, per ``part``."""
    return interactions(masks(docs, labels, part), "".join(CHECKS) + REPEATS)
