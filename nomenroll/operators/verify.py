"""Verification: compare digests by path, or whole tables by key.

Both sides are put on top of each other and grouped, not joined: the grouping combines on the map
side, so a key with very many rows costs no more than others, and repeated keys never pair up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll.functions.digests import row_digest

LANE_BITS = 22
#: Ranges of keys that are compared by their fingerprints.
RANGES = 4096
#: Intervals of keys that are written out as comparisons, which reach the scan.
PUSHED_INTERVALS = 32


def _status(expected_rows: Column, found_rows: Column, differs: Column) -> Column:
    return (
        F.when(found_rows == 0, "missing")
        .when(expected_rows == 0, "extra")
        .when(differs, "mismatch")
        .otherwise("ok")
    )


def last_entry(listed: DataFrame, line: str = "line_no") -> DataFrame:
    """One digest per path; of repeated paths the last line counts."""
    return listed.groupBy("path").agg(F.max_by("digest", line).alias("digest"))


def compare_digests(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``path``, ``status`` (missing, extra, mismatch, unreadable, ok), ``expected``, ``found``.

    A null digest on the found side stands for content that can't be read; it is never ok, and neither is a null
    digest in the list. A path with different digests on one side is a mismatch, whichever is right.
    """
    sides = expected.select("path", F.col("digest").alias("expected"), F.lit(None).cast("string").alias("found"),
                            F.lit(1).alias("in_list"), F.lit(0).alias("on_disk")).unionByName(
        found.select("path", F.lit(None).cast("string").alias("expected"), F.col("digest").alias("found"),
                     F.lit(0).alias("in_list"), F.lit(1).alias("on_disk")))
    merged = sides.groupBy("path").agg(
        F.max("expected").alias("expected"),
        F.max("found").alias("found"),
        (~F.min("expected").eqNullSafe(F.max("expected")) | ~F.min("found").eqNullSafe(F.max("found"))).alias("torn"),
        F.count_if((F.col("on_disk") == 1) & F.col("found").isNull()).alias("unreadable"),
        F.max("in_list").alias("in_list"),
        F.max("on_disk").alias("on_disk"),
    )
    differs = F.col("torn") | ~F.col("expected").eqNullSafe(F.col("found"))
    status = F.when(F.col("unreadable") > 0, "unreadable").otherwise(
        _status(F.col("in_list"), F.col("on_disk"), differs)
    )
    return merged.select("path", status.alias("status"), "expected", "found")


def _values(expected: DataFrame, found: DataFrame, key: Sequence[str], columns: Sequence[str] | None) -> list[str]:
    """The columns to compare; a column that only one side has is an error, unless columns are named."""
    values = list(columns or [c for c in expected.columns if c not in key])
    absent = [c for c in (*key, *values) if c not in found.columns]
    if absent:
        raise ValueError(f"missing column(s) {absent}; available: {found.columns}")
    if added := [c for c in found.columns if c not in expected.columns and not columns]:
        raise ValueError(f"column(s) {added} are in the new table only; name the columns to compare")
    return values


def _lanes(digest: Column) -> list[Column]:
    """128 bits made of a row's digest, in six integers that are small enough to be summed over 2**41 rows."""
    mask = (1 << LANE_BITS) - 1
    return [
        F.shiftrightunsigned(h, LANE_BITS * i).bitwiseAND(mask)
        for h in (F.xxhash64(digest), F.xxhash64(digest, F.lit(1)))
        for i in range(3)
    ]


def _both_sides(expected: DataFrame, found: DataFrame, columns: dict[str, Column], hashed: Sequence[str]) -> DataFrame:
    """``columns`` of all rows, with e (rows expected), f (rows found) and the lanes, which the found side takes away."""
    lanes = _lanes(row_digest(hashed))

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            *[c.alias(n) for n, c in columns.items()],
            F.lit(1 if sign > 0 else 0).alias("e"),
            F.lit(0 if sign > 0 else 1).alias("f"),
            *[(lane * sign).alias(f"lane{i}") for i, lane in enumerate(lanes)],
        )

    return side(expected, 1).unionByName(side(found, -1))


def _summed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """names, e, f and whether the two multisets of rows differ: one grouping, combined on the map side."""
    lanes = [f"lane{i}" for i in range(6)]
    sums = rows.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("e", "f", *lanes)])
    differs = F.col("e") != F.col("f")
    for lane in lanes:
        differs = differs | (F.col(lane) != 0)
    return sums.select(*names, "e", "f", differs.alias("differs"))


def compare_tables(
    expected: DataFrame, found: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Key and ``status`` for every key of two snapshots of a table.

    Rows are compared by digest, as multisets: a repeated key is ok only if both sides hold the same
    rows equally often. A key's multisets are compared by a sum of row hashes, 128 bits that don't depend on the order,
    so one shuffle does. ``columns`` defaults to all but the key; then a column that only ``found`` has is an error.
    """
    values = _values(expected, found, key, columns)
    per_key = _summed(_both_sides(expected, found, {c: F.col(c) for c in key}, values), key)
    return per_key.select(*key, _status(F.col("e"), F.col("f"), F.col("differs")).alias("status"))


# --- by ranges of keys --------------------------------------------------------------------------

#: Types whose values have an order as whole numbers: to the number, and back as a literal.
_AS_NUMBER = {
    "date": (F.unix_date, lambda n: F.date_from_unix_date(F.lit(n))),
    "timestamp": (F.unix_micros, lambda n: F.timestamp_micros(F.lit(n))),
    **dict.fromkeys(("tinyint", "smallint", "int", "bigint"), (lambda c: c.cast("bigint"), lambda n: F.lit(n))),
}


@dataclass(frozen=True)
class KeyRanges:
    """How keys are cut into ranges: by the leading bits of the first key column, or by a hash of all of them."""

    key: tuple[str, ...]
    count: int
    kind: str | None  # type of the first key column, if ranges are intervals of it
    shift: int = 0

    def of(self) -> Column:
        """A row's range; null for a null first key column, if ranges are intervals."""
        if self.kind is None:
            return F.pmod(F.xxhash64(*self.key), F.lit(self.count))
        return F.shiftright(_AS_NUMBER[self.kind][0](F.col(self.key[0])), self.shift)

    def within(self, ranges: Sequence[int | None]) -> Column:
        """Rows of the ranges. Few intervals are compared with the column itself, so that they reach the scan."""
        numbers = sorted(r for r in ranges if r is not None)
        chosen = self.of().isin(numbers) if numbers else F.lit(False)
        if self.kind is not None and numbers:
            first, (_, literal) = F.col(self.key[0]), _AS_NUMBER[self.kind]
            runs: list[list[int]] = []
            for r in numbers:
                if runs and runs[-1][1] == r - 1:
                    runs[-1][1] = r
                else:
                    runs.append([r, r])

            def between(low: int, high: int) -> Column:
                return first.between(literal(low << self.shift), literal(((high + 1) << self.shift) - 1))

            if len(runs) <= PUSHED_INTERVALS:
                chosen = reduce(Column.__or__, [between(*run) for run in runs])
            else:
                chosen = between(runs[0][0], runs[-1][1]) & chosen
        return chosen | self.of().isNull() if None in ranges else chosen


def key_ranges(expected: DataFrame, found: DataFrame, key: Sequence[str], count: int = RANGES) -> KeyRanges:
    """At most ``count`` ranges over the keys of both sides.

    Whole numbers, dates and timestamps in the first key column give intervals of a power of two; other types
    give ranges of a hash.
    """
    kind = expected.schema[key[0]].dataType.simpleString()
    if kind not in _AS_NUMBER or found.schema[key[0]].dataType.simpleString() != kind:
        return KeyRanges(tuple(key), count, None)
    number = _AS_NUMBER[kind][0](F.col(key[0]))
    bounds = [df.agg(F.min(number), F.max(number)).first() for df in (expected, found)]
    low = min((b[0] for b in bounds if b[0] is not None), default=0)
    high = max((b[1] for b in bounds if b[1] is not None), default=0)
    shift = 0
    while (high >> shift) - (low >> shift) >= max(count, 2):  # zero always parts two ranges
        shift += 1
    return KeyRanges(tuple(key), count, kind, shift)


def compare_ranges(
    expected: DataFrame, found: DataFrame, ranges: KeyRanges, columns: Sequence[str] | None = None
) -> DataFrame:
    """``range``, ``expected_rows``, ``found_rows``, ``differs``: set fingerprints of both sides per range of keys.

    A fingerprint is the sum of the hashes of a range's rows, whatever their order, so a task sends one row for each
    range that it has seen and no row of the tables is shuffled.
    """
    values = _values(expected, found, ranges.key, columns)
    rows = _both_sides(expected, found, {"range": ranges.of()}, [*ranges.key, *values])
    return _summed(rows, ["range"]).select(
        "range", F.col("e").alias("expected_rows"), F.col("f").alias("found_rows"), "differs"
    )


def changed_keys(
    expected: DataFrame,
    found: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | None = None,
    count: int = RANGES,
) -> DataFrame:
    """Key and ``status`` of the keys that aren't ok, as ``compare_tables`` would give them.

    Ranges of keys are compared by their fingerprints first, and only rows of ranges that differ are shuffled: between
    two nearly equal snapshots, next to nothing. Ranges that are intervals of the key also keep the scan from
    reading the others again. ``count`` bounds what the driver learns: the numbers of the ranges that differ.
    """
    cut = key_ranges(expected, found, key, count)
    differing = [r.range for r in compare_ranges(expected, found, cut, columns).filter("differs").select("range").collect()]
    if not differing:
        return expected.select(*key, F.lit("ok").alias("status")).filter(F.lit(False))
    inside = cut.within(differing)
    return compare_tables(expected.filter(inside), found.filter(inside), key, columns).filter("status <> 'ok'")


def verdict(compared: DataFrame) -> DataFrame:
    """One row: how many of each status, and whether everything is ok."""
    kinds = ("missing", "extra", "mismatch", "unreadable")
    return compared.agg(
        F.count("*").alias("checked"),
        *[F.count_if(F.col("status") == k).alias(k) for k in kinds],
        (F.count_if(F.col("status") != "ok") == 0).alias("ok"),
    )


def listed_only(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Paths of the list that are not on disk, sorted."""
    return expected.select("path").subtract(found.select("path")).orderBy("path")


def on_both_sides(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that are in the list and on disk, sorted."""
    return expected.select("path").intersect(found.select("path")).orderBy("path")
