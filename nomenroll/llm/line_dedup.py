"""Line deduplication by overlapping windows of three lines.

A window is three consecutive lines that aren't blank, compared without spaces, tabs and carriage returns at their
ends. Of all places where the same window occurs, the first one in order of (doc_id, line) stays; the lines of every
later one are covered, from its first to its last line with the blank ones between. Covered positions of overlapping
windows merge, and what no window covers stays as it is. Windows meet by a 128-bit hash that is grouped with partial
counts; only windows that repeat come back to their places, and only positions go to the texts.

Texts with fewer than three such lines lose nothing. Null text stays null with no lines; empty text is one blank
line. Rows without an id come last in order. Rows that agree in id and text are one document and share its result;
rows that agree in id only are ordered by a hash of their text. Columns n_lines and n_removed replace columns of
those names, and all others pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from nomenroll.llm.common import released, slices, written

WINDOW = 3
ENDS = " \t\r"


def filled_lines(text: str | None) -> tuple[list[str], list[int]]:
    """All lines, and the positions of those that aren't blank."""
    lines = text.split("\n") if text is not None else []
    return lines, [i for i, line in enumerate(lines) if line.strip(ENDS)]


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """known, id, version, h1, h2, first, last: a row for each window of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for known, doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("known", "id", "version", "text"))):
                lines, filled = filled_lines(text)
                digests = [blake2b(lines[i].strip(ENDS).encode(), digest_size=16).digest() for i in filled]
                for k in range(len(filled) - size + 1):
                    key = blake2b(b"".join(digests[k : k + size]), digest_size=16).digest()
                    h1, h2 = (int.from_bytes(x, "little", signed=True) for x in (key[:8], key[8:]))
                    rows.append((known, doc, version, h1, h2, filled[k], filled[k + size - 1]))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["known", "id", "version", "h1", "h2", "first", "last"]
    return docs.select("known", "id", "version", "text").mapInArrow(
        released(run), "known boolean, id long, version long, h1 long, h2 long, first int, last int"
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with later occurrences of repeated windows taken out of ``text``, n_lines and n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keys = {
        "known": F.col(doc_id).isNotNull(),
        "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
        "version": F.xxhash64(text),
        "text": F.col(text),
    }
    found = written(windows(docs.select(*[c.alias(n) for n, c in keys.items()]), size), "windows")
    place = F.struct((~F.col("known")).alias("unknown"), "id", "version", "first")
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("place")).filter("n > 1")
    later = found.join(first.select("h1", "h2", "place"), ["h1", "h2"]).filter(place > F.col("place"))
    covered = later.groupBy("known", "id", "version").agg(F.collect_set(F.struct("first", "last")).alias("__covered"))
    covered = covered.select(F.col("known").alias("__known"), F.col("id").alias("__id"), F.col("version").alias("__version"), "__covered")
    own = [keys["known"] == F.col("__known"), keys["id"] == F.col("__id"), keys["version"] == F.col("__version")]
    on = own[0] & own[1] & own[2]
    both = docs.select(*names).join(covered, on, "left").select(*names, F.col("__covered.first").alias("__first"), F.col("__covered.last").alias("__last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, removed = [], [], []
            for value, begins, ends in zip(batch.column(text).to_pylist(), batch.column("__first").to_pylist(), batch.column("__last").to_pylist()):
                lines = value.split("\n") if value is not None else []
                counts.append(len(lines))
                keep = [True] * len(lines)
                at = 0  # ranges in order, so that each line is covered once
                for begin, end in sorted(zip(begins or [], ends or [])):
                    for i in range(max(begin, at), end + 1):
                        keep[i] = False
                    at = max(at, end + 1)
                texts.append("\n".join([line for line, k in zip(lines, keep) if k]) if value is not None else None)
                removed.append(keep.count(False))
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    schema = StructType([docs.schema[n] if n != text else docs.schema[n].__class__(n, StringType()) for n in names])
    return both.mapInArrow(released(run), schema.add("n_lines", LongType()).add("n_removed", LongType()))
