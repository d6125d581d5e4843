"""Inventories and quality splits on disk.

Writers rebalance their rows by class: adaptive execution measures the bytes that each task holds of each class, splits
large classes into write tasks of about ``target_bytes`` and puts small pieces together. (A plain shuffle by class
would make six tasks, one of them with half of the data, and no shuffle at all six files for each task.) With
``target_bytes=None`` rows are written by the tasks that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from csv import reader as csv_reader

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nomenroll import constants as K
from nomenroll.session import scratch_path
from nomenroll.sources.artifacts import BLOCK_BYTES, opener
from nomenroll.sources.corpus import CSV_OPTIONS, text_schema
from nomenroll.sources.folders import children, publish

TARGET_BYTES = 128 << 20
CSV_WRITE = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CLASS_FILES = {f"{K.INVENTORY_NAMES[c]}.csv": K.INVENTORY_COLUMNS[c] for c in K.ENTITY_CLASSES}


def context_of_path(path: Column) -> Column:
    """Lower-case file name without its extension."""
    return F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def context_of_class(entity_class: Column) -> Column:
    """Inventory name of a class, e.g. PER -> pers."""
    name = F.lower(entity_class)
    for c in K.ENTITY_CLASSES:
        name = F.when(entity_class == c, K.INVENTORY_NAMES[c]).otherwise(name)
    return name


def _write_sized(rows: DataFrame, by: Sequence[str], target_bytes: int | None, write: Callable[[DataFrame], None]) -> None:
    """``write`` rows rebalanced by the columns ``by``, in tasks of about ``target_bytes``."""
    if target_bytes is None:
        write(rows)
        return
    conf, name = rows.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = conf.get(name, None)
    conf.set(name, str(target_bytes))
    try:
        write(rows.hint("rebalance", *[F.col(c) for c in by]))
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def write_inventory(
    inventory: DataFrame, path: str, file_format: str = "parquet", target_bytes: int | None = TARGET_BYTES
) -> None:
    options = CSV_WRITE if file_format == "csv" else {}
    _write_sized(
        inventory,
        ["entity_class"],
        target_bytes,
        lambda rows: rows.write.mode("overwrite").partitionBy("entity_class").options(**options).format(file_format).save(path),
    )


def read_inventory(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet"
) -> DataFrame:
    """Read what ``write_inventory`` wrote; text such as ``NA`` or ``007`` stays text."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.format(file_format).load(path)


def write_class_files(inventory: DataFrame, directory: str, classes: Sequence[str] = K.ENTITY_CLASSES) -> None:
    """One CSV file for each class, with the class's own entity column; the format asks for single files.

    The inventory is made once, and written as lines by the tasks that hold it. What a single file needs is done on
    bytes only: a task for each class puts its lines behind one another, block by block.
    """
    spark = inventory.sparkSession
    parts = scratch_path(spark, "class-lines")
    rows = inventory.filter(F.col("entity_class").isin(*classes)).select(
        "entity_class", F.coalesce("entity", F.lit("")).alias("entity")  # a line without anything would be skipped
    )
    rows.write.partitionBy("entity_class").options(**{**CSV_WRITE, "header": False}).csv(parts)
    opened = opener()

    def join_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for batch in batches:
            written = []
            for name, column in zip(batch["name"], batch["column"]):
                system, inside = opened(f"{parts}/entity_class={name}")
                found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
                full = f"{parts}/{uuid.uuid4().hex}.csv"  # a task that runs again writes another file
                with system.open_output_stream(opened(full)[1]) as out:
                    out.write(f"{column}\n".encode())
                    for path in sorted(i.path for i in found if i.base_name.endswith(".csv") and i.base_name[0] not in "._"):
                        with system.open_input_stream(path) as lines:
                            while block := lines.read(BLOCK_BYTES):
                                out.write(block)
                written.append(full)
            yield pd.DataFrame({"name": batch["name"], "full": written})

    wanted = spark.createDataFrame([(c, K.INVENTORY_COLUMNS[c]) for c in classes], "name string, column string")
    joined = wanted.repartition(max(1, len(classes))).mapInPandas(join_lines, "name string, full string").collect()
    for row in joined:
        publish(spark, row.full, f"{directory}/{K.INVENTORY_NAMES[row.name]}.csv")


def class_headers(spark: SparkSession, directory: str, files: Mapping[str, str] = CLASS_FILES) -> dict[str, list[str]]:
    """The columns of each of ``files`` that is in the directory: one listing, and one job that reads first lines only."""
    present = [(f, f"{directory.rstrip('/')}/{f}") for f in children(spark, directory) if f in files]
    if not present:
        return {}
    opened = opener()

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            headers = []
            for full in batch["full"]:
                system, inside = opened(full)
                with system.open_input_stream(inside) as content:
                    lines = io.TextIOWrapper(content, encoding="utf-8-sig", newline="")
                    headers.append(next(csv_reader(lines), []))
            yield pd.DataFrame({"name": batch["name"], "header": headers})

    listed = spark.createDataFrame(present, "name string, full string").repartition(len(present))
    return {r.name: list(r.header) for r in listed.mapInPandas(first_lines, "name string, header array<string>").collect()}


def read_class_files(
    spark: SparkSession, directory: str, files: Mapping[str, str] = CLASS_FILES, multi_line: bool = True
) -> DataFrame:
    """Import per-class CSV files, named by ``files`` (file name -> entity column).

    Absent files are skipped. All headers are checked before anything is read: files without their entity column are
    an error that names them all. Gives ``context``, from the name of the file that a row is read from, and
    ``entity``. The loop runs over the names of ``files``, not over data. Without line breaks inside entities,
    ``multi_line=False`` lets many tasks read one large file.
    """
    headers = class_headers(spark, directory, files)
    wrong = {f: h for f, h in headers.items() if files[f] not in h}
    if wrong:
        said = "; ".join(f"{f} has no column {files[f]!r}; available: {h}" for f, h in sorted(wrong.items()))
        raise ValueError(said)
    result = spark.createDataFrame([], text_schema(["context", "entity"]))
    for name, header in sorted(headers.items()):
        rows = spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line}).schema(text_schema(header)).csv(f"{directory.rstrip('/')}/{name}")
        result = result.unionByName(
            rows.select(context_of_path(F.col("_metadata.file_path")).alias("context"), F.coalesce(files[name], F.lit("")).alias("entity"))
        )
    return result


def write_split(checked: DataFrame, path: str, target_bytes: int | None = TARGET_BYTES) -> None:
    """Clean and flagged rows in one pass: ``split=clean`` and ``split=flagged`` below each context."""
    split = F.when(F.col("_qc_flag"), "flagged").otherwise("clean")
    by = ["context", "split"]
    rows = checked.withColumn("split", split).drop("_qc_flag")
    _write_sized(rows, by, target_bytes, lambda r: r.write.mode("overwrite").partitionBy(*by).parquet(path))


def read_split(spark: SparkSession, path: str, split: str, schema: T.StructType | None = None) -> DataFrame:
    """One side of ``write_split``; only its directories are read.

    A split without any row has no files to learn a schema from; give ``schema`` where that may be.
    """
    if split not in ("clean", "flagged"):
        raise ValueError(f"split is clean or flagged, not {split!r}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.parquet(path).filter(F.col("split") == split).drop("split")
    return rows.drop("_qc_rules", "_qc_first_rule") if split == "clean" else rows


def write_raw_copy(
    checked: DataFrame, path: str, columns: Sequence[str] = ("context", "entity"), target_bytes: int | None = TARGET_BYTES
) -> None:
    """The normalized entities of all rows."""
    rows = checked.select(*columns)
    _write_sized(rows, ["context"], target_bytes, lambda r: r.write.mode("overwrite").partitionBy("context").parquet(path))
