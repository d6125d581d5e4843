"""The n-th smallest key of a table, without sorting it and without a task that sees ``n`` keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that part a range, and keys that they are chosen from, about.
PIVOTS, SAMPLE = 63, 1024


def comparable(df: DataFrame, key: str) -> Column:
    """The key as a value that survives the way to the driver and back; timestamps as microseconds."""
    return F.unix_micros(key) if df.schema[key].dataType.simpleString() == "timestamp" else F.col(key)


def _bin(key: Column, pivots: Sequence) -> Column:
    """How many pivots are smaller than the key: a decision tree, six comparisons deep for 63 pivots."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= F.lit(pivots[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(pivots))


def nth_smallest(df: DataFrame, key: str, n: int):
    """The ``n``-th smallest key that isn't null, the largest one if there are fewer; None for an empty table.

    A histogram is refined: some keys, picked by their hash, part the range that holds the n-th key, each part is
    counted, and the part with the n-th key is the next range. Counts and pivots are all that reaches the driver, and a
    round leaves about a fiftieth of the range. Where a range is sorted on disk, later rounds skip most row groups.
    """
    keys = df.select(comparable(df, key).alias("k")).filter("k IS NOT NULL")
    size, high = keys.agg(F.count("*"), F.max("k")).first()
    if n >= size:
        return high
    low, rank, aim = None, n, SAMPLE
    while True:
        part = keys.filter(F.col("k") <= F.lit(high))
        if low is not None:
            part = part.filter(F.col("k") > F.lit(low))
        every = max(1, size // aim)
        picked = part.filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct().orderBy("k")
        found = [r.k for r in picked.collect()]
        pivots = found if len(found) <= PIVOTS else [found[(i + 1) * len(found) // (PIVOTS + 1)] for i in range(PIVOTS)]
        counts = {r.b: r["count"] for r in part.groupBy(_bin(F.col("k"), pivots).alias("b")).count().collect()}
        chosen = 0
        while rank > counts.get(chosen, 0):
            rank -= counts.get(chosen, 0)
            chosen += 1
        before = (low, high)
        low, high = (pivots[chosen - 1] if chosen else low), (pivots[chosen] if chosen < len(pivots) else high)
        size = counts[chosen]
        if every == 1 and pivots is found:
            return high  # every key is a pivot
        # few distinct keys, repeated often, may all be missed: then more are looked at
        aim = aim * 64 if (low, high) == before else SAMPLE
