"""Marked compaction of tables that a stream writes batch by batch.

Batches up to a mark are merged into one folder whose name is the mark: ``_compacted/<table>/upto=<id>``. It is written
under a temporary name and published by one rename, which moves the mark. Readers take the folder with the largest
mark and the batches after it, so a stop between any two steps changes no result: before the rename the merged rows
aren't seen, and after it the batches that they hold aren't. The newest batch is never merged, since a restarted
stream may write it again; all before it are committed. One compaction of a table runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenroll.sources.folders import children, publish, remove

Merge = Callable[[DataFrame], DataFrame]


def _home(out_dir: str, table: str) -> str:
    return f"{out_dir}/_compacted/{table}"


def _numbers(names: list[str], prefix: str) -> list[int]:
    found = [n.removeprefix(prefix) for n in names if n.startswith(prefix)]
    return sorted(int(n) for n in found if n.isdigit())


def marks(spark: SparkSession, out_dir: str, table: str) -> list[int]:
    """Published marks, ascending; the last one counts."""
    return _numbers(children(spark, _home(out_dir, table)), "upto=")


def batches(spark: SparkSession, out_dir: str, table: str) -> list[int]:
    return _numbers(children(spark, f"{out_dir}/{table}"), "batch=")


def read_marked(spark: SparkSession, out_dir: str, table: str, upto: int | None = None) -> DataFrame:
    """Rows below the mark, and of the batches after it (``upto`` one of them, if given)."""
    mark = max(marks(spark, out_dir, table), default=-1)
    later = [b for b in batches(spark, out_dir, table) if b > mark and (upto is None or b <= upto)]
    parts = [f"{_home(out_dir, table)}/upto={mark}"] if mark >= 0 else []
    parts += [f"{out_dir}/{table}/batch={b}" for b in later]
    if not parts:
        raise FileNotFoundError(f"no batch of {table} below {out_dir}")
    return spark.read.parquet(*parts)


def merged(spark: SparkSession, out_dir: str, table: str, upto: int, merge: Merge | None = None) -> str:
    """Step one: the rows of all batches up to ``upto``, in a folder that nobody reads yet."""
    rows = read_marked(spark, out_dir, table, upto)
    path = f"{_home(out_dir, table)}/_new-{uuid.uuid4().hex}"
    (merge(rows) if merge else rows.hint("rebalance")).write.parquet(path)
    return path


def compact(spark: SparkSession, out_dir: str, table: str, merge: Merge | None = None) -> int:
    """Merge all batches but the newest; the new mark, or the old one if there is nothing to merge.

    ``merge`` may put rows together, such as sums of counts; else they are only dealt into larger files.
    """
    mark = max(marks(spark, out_dir, table), default=-1)
    ready = [b for b in batches(spark, out_dir, table)[:-1] if b > mark]
    if not ready:
        return mark
    path = merged(spark, out_dir, table, ready[-1], merge)
    publish(spark, path, f"{_home(out_dir, table)}/upto={ready[-1]}")  # step two: the mark moves
    return ready[-1]


def clean(spark: SparkSession, out_dir: str, table: str) -> None:
    """Step three, at any later time: remove what the mark before the last one has made superfluous.

    What only the last mark replaces stays, for readers that began before it.
    """
    known = marks(spark, out_dir, table)
    for mark in known[:-2]:
        remove(spark, f"{_home(out_dir, table)}/upto={mark}")
    if len(known) > 1:
        for batch in batches(spark, out_dir, table):
            if batch <= known[-2]:
                remove(spark, f"{out_dir}/{table}/batch={batch}")


def summed(by: list[str], counts: list[str]) -> Merge:
    return lambda rows: rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts]).coalesce(1)


#: How the tables of a stream are merged: counts are added up, a few rows per context and rule.
MERGES: dict[str, Merge | None] = {
    "totals": summed(["context"], ["rows_total", "rows_flagged"]),
    "rule_counts": summed(["context", "rule"], ["rows"]),
    "processed": None,
    "inventory": None,
}


def compact_all(spark: SparkSession, out_dir: str) -> dict[str, int]:
    """The mark of each table that is there, after its compaction and cleaning."""
    result = {}
    for table, merge in MERGES.items():
        if batches(spark, out_dir, table):
            result[table] = compact(spark, out_dir, table, merge)
            clean(spark, out_dir, table)
    return result
