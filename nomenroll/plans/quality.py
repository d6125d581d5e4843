"""Inventory -> clean and flagged rows, and the audit report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.operators.report import (
    examples,
    ledger,
    nested_reports,
    rule_counts,
    top_entities,
    totals,
)
from nomenroll.operators.rules import RULES, Rule, RuleSettings, with_rules
from nomenroll.session import materialize
from nomenroll.sources.inventory import TARGET_BYTES, context_of_class, write_raw_copy, write_split


def with_context(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("context", context_of_class(F.col("entity_class")))


def run_quality(
    rows: DataFrame,
    order: Column,
    out_dir: str,
    settings: RuleSettings = RuleSettings(),
    rules: Sequence[Rule] = RULES,
    k_examples: int = K.EXAMPLES_PER_RULE,
    k_top: int = K.TOP_ENTITIES,
    raw_copy: bool = False,
    generated_at: str | None = None,
    target_bytes: int | None = TARGET_BYTES,
) -> DataFrame:
    """Split ``rows`` (``context``, ``entity``, ...) below ``out_dir`` and write the report tables.

    Rows are made and checked once: split, raw copy and ledger are made from that table, below the shared folder. They are
    split without a shuffle by key. The ledger is written once, each report table is an aggregate of it, and
    the nested report, which is returned, is put together from the written tables.
    """
    spark = rows.sparkSession
    ordered = with_rules(rows.withColumn("_qc_order", order), settings=settings, rules=rules)
    ordered = materialize(ordered, "checked")
    checked = ordered.drop("_qc_order")
    write_split(checked, f"{out_dir}/split", target_bytes)
    if raw_copy:
        write_raw_copy(checked, f"{out_dir}/raw", target_bytes=target_bytes)

    book = ledger(ordered, F.col("_qc_order"), settings=settings, rules=rules)
    book.write.mode("overwrite").parquet(f"{out_dir}/ledger")
    book = spark.read.schema(book.schema).parquet(f"{out_dir}/ledger")
    parts = {
        "totals": totals(book),
        "rule_counts": rule_counts(book),
        "examples": examples(book, k_examples),
        "top_entities": top_entities(book, k_top),
    }
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{out_dir}/report/{name}")
        parts[name] = spark.read.schema(part.schema).parquet(f"{out_dir}/report/{name}")

    limits = asdict(settings.thresholds)
    report = nested_reports(**parts).select(
        "*",
        F.lit(out_dir).alias("output_dir"),
        F.create_map(*[x for k in sorted(limits) for x in (F.lit(k), F.lit(float(limits[k])))]).alias("thresholds"),
        F.lit(generated_at).cast("string").alias("generated_at"),
    )
    report.write.mode("overwrite").json(f"{out_dir}/report/nested", ignoreNullFields=generated_at is None)
    return report
