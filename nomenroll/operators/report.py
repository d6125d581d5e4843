"""The audit report.

All parts come from one *ledger*: a row per distinct (inventory, entity) with its number of
mentions, its first position and its rules. Rules depend on nothing else, so they are evaluated once
per distinct entity, and the mentions are shuffled once, combined on the map side: an entity that
makes up a third of all mentions arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.functions.whitespace import normalize_entity
from nomenroll.operators.rules import RULES, Rule, RuleSettings, rule_rank, with_rules


def ledger(
    rows: DataFrame,
    order: Column,
    entity: str = "entity",
    context: str = "context",
    settings: RuleSettings = RuleSettings(),
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Distinct entities: ``context``, ``entity``, ``mentions``, ``first_seen`` and the rule columns.

    ``order`` says which mention comes first; tables have no order of their own, so it is required.
    """
    distinct = (
        rows.select(
            F.col(context).alias("context"),
            normalize_entity(F.col(entity)).alias("entity"),
            order.alias("ord"),
        )
        .groupBy("context", "entity")
        .agg(F.count("*").alias("mentions"), F.min("ord").alias("first_seen"))
    )
    return with_rules(distinct, settings=settings, rules=rules)


def totals(book: DataFrame) -> DataFrame:
    """Rows, flagged and clean per inventory; ``overall`` is true on the one row for all of them."""
    flagged = F.coalesce(F.sum(F.when(F.col("_qc_flag"), F.col("mentions"))), F.lit(0))
    return (
        book.rollup("context")
        .agg(
            F.grouping("context").alias("g"),
            F.coalesce(F.sum("mentions"), F.lit(0)).alias("rows_total"),
            flagged.alias("rows_flagged"),
        )
        .select(
            "context",
            (F.col("g") == 1).alias("overall"),
            "rows_total",
            "rows_flagged",
            (F.col("rows_total") - F.col("rows_flagged")).alias("rows_clean"),
        )
    )


def _hits(book: DataFrame) -> DataFrame:
    return book.select("context", "entity", "mentions", "first_seen", F.explode("_qc_rules").alias("rule"))


def rule_counts(book: DataFrame) -> DataFrame:
    """Mentions per inventory and rule, and per rule over all inventories (``overall``)."""
    context, rule = F.col("context"), F.col("rule")
    return (
        _hits(book)
        .groupingSets([[context, rule], [rule]], context, rule)
        .agg(F.grouping("context").alias("g"), F.sum("mentions").alias("rows"))
        .select("context", (F.col("g") == 1).alias("overall"), rule_rank(rule).alias("rank"), "rule", "rows")
    )


def examples(book: DataFrame, k: int = K.EXAMPLES_PER_RULE) -> DataFrame:
    """The first ``k`` distinct entities per inventory and rule, numbered from 1."""
    by_first = Window.partitionBy("context", "rule").orderBy("first_seen", "entity")
    return (
        _hits(book)
        .withColumn("nth", F.row_number().over(by_first))
        .filter(F.col("nth") <= k)
        .select("context", "rule", F.col("nth").cast("bigint").alias("nth"), "entity")
    )


def top_entities(book: DataFrame, k: int = K.TOP_ENTITIES) -> DataFrame:
    """The ``k`` most frequent clean entities per inventory; equal counts by entity."""
    by_count = Window.partitionBy("context").orderBy(F.desc("mentions"), "entity")
    return (
        book.filter(~F.col("_qc_flag"))
        .withColumn("nth", F.row_number().over(by_count))
        .filter(F.col("nth") <= k)
        .select("context", F.col("nth").cast("bigint").alias("nth"), "entity", F.col("mentions").alias("count"))
    )


def _ordered_map(rank: Column, name: Column, value: Column) -> Column:
    """Map in the order of ``rank`` and then ``name``."""
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), name.alias("name"), value.alias("value"))))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["name"], r["value"])))


def rule_count_maps(counts: DataFrame) -> DataFrame:
    """One ordered map rule -> rows for each inventory and one overall; at most one entry per rule."""
    return counts.groupBy("context", "overall").agg(
        _ordered_map(F.col("rank"), F.col("rule"), F.col("rows")).alias("rule_counts")
    )


def example_maps(sample: DataFrame) -> DataFrame:
    """One ordered map rule -> list of examples for each inventory."""
    per_rule = sample.groupBy("context", "rule").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "entity"))), lambda s: s["entity"]).alias("listed")
    )
    return per_rule.groupBy("context").agg(
        _ordered_map(rule_rank(F.col("rule")), F.col("rule"), F.col("listed")).alias("examples_by_rule")
    )


def top_lists(top: DataFrame) -> DataFrame:
    """One list of (entity, count) for each inventory, most frequent first."""
    listed = F.array_sort(F.collect_list(F.struct("nth", "entity", "count")))
    return top.groupBy("context").agg(
        F.transform(listed, lambda s: F.struct(s["entity"].alias("entity"), s["count"].alias("count"))).alias(
            "top_entities_clean"
        )
    )


def inventory_reports(book: DataFrame, k_examples: int = K.EXAMPLES_PER_RULE, k_top: int = K.TOP_ENTITIES) -> DataFrame:
    """One nested row per inventory, and one overall row (null ``context``) without lists."""
    return nested_reports(totals(book), rule_counts(book), examples(book, k_examples), top_entities(book, k_top))


def nested_reports(totals: DataFrame, rule_counts: DataFrame, examples: DataFrame, top_entities: DataFrame) -> DataFrame:
    """The nested rows from the four report tables, which may have been read back.

    The joined parts have one row per inventory each.
    """
    counts = rule_count_maps(rule_counts)
    parts = totals.join(
        counts.withColumnRenamed("context", "c").withColumnRenamed("overall", "o"),
        F.col("context").eqNullSafe(F.col("c")) & (F.col("overall") == F.col("o")),
        "left",
    ).drop("c", "o")
    parts = parts.join(example_maps(examples), "context", "left")
    parts = parts.join(top_lists(top_entities), "context", "left")
    return parts.select(
        "context",
        "overall",
        "rows_total",
        "rows_flagged",
        "rows_clean",
        F.coalesce("rule_counts", F.create_map().cast("map<string,bigint>")).alias("rule_counts"),
        F.coalesce("examples_by_rule", F.create_map().cast("map<string,array<string>>")).alias("examples_by_rule"),
        F.coalesce("top_entities_clean", F.array().cast("array<struct<entity:string,count:bigint>>")).alias(
            "top_entities_clean"
        ),
    )
