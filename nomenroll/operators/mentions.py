"""From span arrays to the inventory: one row per mention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nomenroll import constants as K
from nomenroll.functions.ordering import packed_order
from nomenroll.functions.spans import parse_entities
from nomenroll.functions.whitespace import strip


def _canonical_type(kind: Column, aliases: Mapping[str, str]) -> Column:
    """Upper-case type; ``aliases`` maps further names to classes."""
    upper = F.upper(kind)
    result = upper
    for name, target in aliases.items():
        result = F.when(upper == name.upper(), target).otherwise(result)
    return result


def explode_spans(df: DataFrame, key: Sequence[str], spans: Mapping[str, str]) -> DataFrame:
    """All spans of all fields in long form, from one pass; ``spans`` maps field to span column."""
    pairs = [part for field, column in spans.items() for part in (F.lit(field), F.col(column))]
    return (
        df.select(*key, F.stack(F.lit(len(spans)), *pairs).alias("field", "found"))
        .select(*key, "field", F.explode("found").alias("found"))
        .select(*key, "field", "found.*")
    )


def _as_mention(kind: Column, text: Column, aliases: Mapping[str, str]) -> tuple[Column, Column]:
    return _canonical_type(kind, aliases).alias("entity_class"), strip(text).alias("entity")


def mentions_of(
    spans: DataFrame,
    key: Sequence[str],
    classes: Sequence[str] = K.ENTITY_CLASSES,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inventory rows of long spans: known classes only, text stripped, blank text dropped."""
    entity_class, entity = _as_mention(F.col("type"), F.col("text"), aliases or {})
    return spans.select(entity_class, entity, *key, "field", "start_char", "end_char").filter(
        F.col("entity_class").isin(*classes) & (F.col("entity") != "")
    )


def mentions(
    df: DataFrame,
    key: Sequence[str],
    spans: Mapping[str, str],
    classes: Sequence[str] = K.ENTITY_CLASSES,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inventory rows of a table that holds span arrays, e.g. ``{"title": "entities_title"}``."""
    return mentions_of(explode_spans(df, key, spans), key, classes, aliases)


def mentions_from_json(df: DataFrame, key: Sequence[str], columns: Mapping[str, str], **options) -> DataFrame:
    """Inventory rows of a processed table, whose spans are JSON text."""
    parsed = df.select(*key, *[parse_entities(F.col(c)).alias(c) for c in columns.values()])
    return mentions(parsed, key, columns, **options)


def dropped_types(spans: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Spans per type that no inventory takes."""
    kind = _canonical_type(F.col("type"), aliases or {})
    return (
        spans.select(kind.alias("type")).filter(~F.col("type").isin(*K.ENTITY_CLASSES)).groupBy("type").agg(
            F.count("*").alias("spans")
        )
    )


def mention_order(df: DataFrame, key: Sequence[str], fields: Sequence[str] = ("title", "content")) -> Column:
    """Reading order of mentions: document, title before content, position.

    A single integer key gives a packed number, any other key a struct.
    """
    rank = F.lit(len(fields))
    for position, field in enumerate(fields):
        rank = F.when(F.col("field") == field, position).otherwise(rank)
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, T.IntegralType):
        return packed_order((F.col(key[0]), 19), (rank, 1), (F.col("start_char"), 10))
    return F.struct(*key, rank.alias("field_rank"), "start_char", "end_char")


def class_table(spark: SparkSession) -> DataFrame:
    """The six classes with their inventory and column names."""
    rows = [(c, K.INVENTORY_NAMES[c], K.INVENTORY_COLUMNS[c]) for c in K.ENTITY_CLASSES]
    return spark.createDataFrame(rows, "entity_class string, inventory string, entity_column string")


def with_inventory_names(df: DataFrame) -> DataFrame:
    """Add inventory and column name of the class; the joined table has six rows, always."""
    return df.join(F.broadcast(class_table(df.sparkSession)), "entity_class", "left")


def mention_counts(inventory: DataFrame) -> DataFrame:
    """Mentions per class; a class without mentions counts zero."""
    counted = inventory.groupBy("entity_class").agg(F.count("*").alias("mentions"))
    return (
        class_table(inventory.sparkSession)
        .join(counted, "entity_class", "left")
        .withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    )


def single_class(inventory: DataFrame, entity_class: str) -> DataFrame:
    """One class as a table with its contract column; on a partitioned table only that part is read."""
    if entity_class not in K.ENTITY_CLASSES:
        raise ValueError(f"unknown class {entity_class!r}; known: {K.ENTITY_CLASSES}")
    return inventory.filter(F.col("entity_class") == entity_class).select(
        F.col("entity").alias(K.INVENTORY_COLUMNS[entity_class])
    )


def classes_present(inventory: DataFrame, expected: Sequence[str] = K.ENTITY_CLASSES) -> DataFrame:
    """Expected classes that have rows, by inventory name."""
    if "entity_class" not in inventory.columns or "entity" not in inventory.columns:
        raise ValueError(f"an inventory has entity_class and entity; found {inventory.columns}")
    present = inventory.select("entity_class").distinct()
    table = class_table(inventory.sparkSession).filter(F.col("entity_class").isin(*expected))
    return table.join(present, "entity_class", "left_semi").orderBy("inventory")
