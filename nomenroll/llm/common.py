"""Small helpers of the corpus operators: inputs, batches, hashes, written tables, connected components."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenroll.session import scratch_path

#: A-Z to a-z and nothing else, as the contracts ask.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def written(df: DataFrame, label: str, compression: str | None = None, *by: str) -> DataFrame:
    """``df`` as a table below the shared folder: lineage ends there, and lost executors cost no more than their tasks. Who
    reads some values of the columns ``by`` opens their files only."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action of this session go when the action ends, not when the driver happens to
    collect its garbage. What is read again has to be a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def planes(numbers: np.ndarray, width: int | None = None) -> bytes:
    """The lowest ``width`` bytes of each number, first bytes first: small numbers leave planes of zeros, which compress."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize)[:, :width].T.tobytes()


def unplaned(data: bytes, kind: type, width: int | None = None) -> np.ndarray:
    """The inverse of ``planes``."""
    size = np.dtype(kind).itemsize
    width = width or size
    result = np.zeros((len(data) // width, size), dtype=np.uint8)
    result[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, len(result)).T
    return result.view(kind).ravel()


def trim() -> None:
    """Give memory that isn't in use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc
        trim(0)


def keep_memory() -> None:
    """Use the memory of freed arrays again, until ``trim``: asking the system for it anew costs more than many a sum."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:  # glibc: arrays of up to 32 MiB come from the heap, whose free end stays
        option(-3, 32 << 20)
        option(-1, 256 << 20)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, a function of batches for ``mapInArrow``, that leaves little behind: workers are used again by later tasks,
    and what an earlier one has freed would else stay with the process."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that Python holds few texts at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` of UTF-8: exactly what ``bytes`` methods do."""
    return text.lower().split()


def crc_text(value: int) -> int:
    return zlib.crc32(str(value).encode())


def components(edges: DataFrame, label: str = "components", rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph: ``edges`` (a, b: long) to (node, component: its smallest node).

    Alternating star contraction: each node hangs its larger neighbours on its smallest one, then its smaller
    neighbours, until nothing changes; every round is a written table and two groupings with min and no collected
    groups, so a node with a third of all edges is pre-aggregated like any other. Nulls and loops are left out,
    repeated edges count once. An empty table gives an empty table.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    current = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), label)
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        after = written(small.select("e.a", "e.b").filter("a <> b").distinct(), label)
        forest = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        if forest and after.join(after.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_semi").isEmpty():
            current = after
            break
        current = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
