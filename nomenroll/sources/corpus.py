"""Corpus readers, batch and stream, and the processed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nomenroll.functions.spans import entities_json

# Doubled quotes and quoted line breaks. multiLine files are read whole by one task each, so a large
# corpus should be converted to Parquet once and read from there.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """All columns as text. Names come from the header, or are ``columns`` and checked against it.

    Without line breaks inside fields, ``multi_line=False`` lets many tasks read one large file.
    """
    reader = spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line})
    if columns is not None:
        reader = reader.schema(text_schema(columns)).option("enforceSchema", False)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.schema(text_schema(columns)).json(path)


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files_per_batch: int = 1000,
    **options,
) -> DataFrame:
    """New files below ``path`` as a stream, at most ``files_per_batch`` at a time."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if file_format == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.options(**options).load(path)


def processed_json(annotated: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Key, title, link, and the spans of the annotated fields as JSON text."""
    spans = [c for c in ("entities_title", "entities_content") if c in annotated.columns]
    return annotated.select(*key, "title", "link", *[entities_json(F.col(c)).alias(c) for c in spans])


def write_csv(df: DataFrame, path: str) -> None:
    """Text columns as CSV that ``read_csv`` reads back unchanged."""
    df.write.mode("overwrite").options(
        header=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
