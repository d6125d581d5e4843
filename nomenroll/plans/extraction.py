"""Corpus -> processed table -> inventories, with run metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.functions.persian import NormalizeConfig
from nomenroll.functions.spans import no_spans
from nomenroll.operators.corpus import clean_text, fields_of
from nomenroll.operators.gazetteer import Gazetteer, attach_spans, gazetteer_spans
from nomenroll.operators.mentions import dropped_types, explode_spans, mentions_of
from nomenroll.session import observed
from nomenroll.sources.inventory import TARGET_BYTES, read_inventory, write_inventory

Annotator = Callable[[Column], Column]


def annotate_fields(
    corpus: DataFrame,
    key: Sequence[str],
    annotate: Annotator,
    text_field: str = "both",
    config: NormalizeConfig = NormalizeConfig(),
    keep_text: bool = False,
) -> DataFrame:
    """Key, title, link and ``entities_<field>`` span arrays for the chosen fields.

    ``keep_text`` also keeps the normalized text, in which the offsets count.
    """
    chosen = fields_of(text_field)
    cleaned = clean_text(corpus, config)
    kept = [f"norm_{f}" for f in chosen] if keep_text else []
    # Empty text has no entities, whatever the annotator does with it.
    found = [
        F.when(F.col(f"norm_{f}") != "", annotate(F.col(f"norm_{f}"))).otherwise(no_spans()).alias(f"entities_{f}")
        for f in chosen
    ]
    return cleaned.select(*key, "title", "link", *kept, *found)


def gazetteer_fields(
    corpus: DataFrame,
    key: Sequence[str],
    gazetteer: Gazetteer,
    text_field: str = "both",
    config: NormalizeConfig = NormalizeConfig(),
) -> DataFrame:
    """The same contract as ``annotate_fields``, from a gazetteer.

    Only key, title and link are joined with the spans; document text is not moved.
    """
    result = corpus.select(*key, "title", "link")
    cleaned = clean_text(corpus, config)
    for field in fields_of(text_field):
        spans = gazetteer_spans(cleaned.select(*key, f"norm_{field}"), key, f"norm_{field}", gazetteer)
        result = attach_spans(result, spans, key, f"entities_{field}")
    return result


def span_columns(annotated: DataFrame) -> dict[str, str]:
    return {f: f"entities_{f}" for f in ("title", "content") if f"entities_{f}" in annotated.columns}


def inventory_of(annotated: DataFrame, key: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    return mentions_of(explode_spans(annotated, key, span_columns(annotated)), key, aliases=aliases)


def run_extraction(
    annotated: DataFrame,
    key: Sequence[str],
    out_dir: str,
    options: Mapping[str, str] | None = None,
    config: NormalizeConfig = NormalizeConfig(),
    aliases: Mapping[str, str] | None = None,
    generated_at: str | None = None,
    target_bytes: int | None = TARGET_BYTES,
) -> DataFrame:
    """Write ``processed``, ``inventory`` and a row of ``runs`` below ``out_dir``; return that row.

    The processed table is written first and the inventory is made from it: the annotator, the one
    costly step, runs once, and a lost executor only repeats its own tasks.
    """
    spark = annotated.sparkSession
    rows_seen, mentions_seen = Observation("rows"), Observation("mentions")
    one = F.count(F.lit(1)).alias("n")
    annotated.observe(rows_seen, one).write.mode("overwrite").parquet(f"{out_dir}/processed")
    processed = spark.read.schema(annotated.schema).parquet(f"{out_dir}/processed")
    inventory = inventory_of(processed, key, aliases)
    write_inventory(inventory.observe(mentions_seen, one), f"{out_dir}/inventory", target_bytes=target_bytes)

    # Counted from what was committed, beside what was observed on the way there.
    written = read_inventory(spark, f"{out_dir}/inventory", inventory.schema).groupBy("entity_class").count()
    spans = explode_spans(processed, key, span_columns(processed))
    metrics = run_metrics(
        rows=processed.count(),
        mentions={**dict.fromkeys(K.ENTITY_CLASSES, 0), **{r.entity_class: r["count"] for r in written.collect()}},
        dropped=dropped_types(spans, aliases),
        text_field="+".join(span_columns(annotated)),
        options={**(options or {}), **{k: str(v) for k, v in asdict(config).items()}},
        generated_at=generated_at,
        seen=(observed(rows_seen, "n"), observed(mentions_seen, "n")),
    )
    metrics.write.mode("append").parquet(f"{out_dir}/runs")
    return metrics


def run_metrics(
    rows: int,
    mentions: Mapping[str, int],
    dropped: DataFrame,
    text_field: str,
    options: Mapping[str, str],
    generated_at: str | None = None,
    seen: tuple[int, int] | None = None,
) -> DataFrame:
    """One row about a run; without ``generated_at`` it depends on nothing but the run itself.

    ``seen`` rows and mentions are those that went to the writers; ``agrees`` says whether as many are in the tables.
    """
    entries = F.array_sort(F.collect_list(F.struct("type", "spans")))
    return dropped.agg(F.map_from_entries(entries).alias("dropped_types")).select(
        F.lit(text_field).alias("text_field"),
        F.lit(rows).cast("bigint").alias("rows_in"),
        F.create_map(*[x for c in K.ENTITY_CLASSES for x in (F.lit(c), F.lit(mentions[c]).cast("bigint"))]).alias(
            "mentions"
        ),
        "dropped_types",
        F.create_map(*[x for k in sorted(options) for x in (F.lit(k), F.lit(options[k]))])
        .cast("map<string,string>")
        .alias("options"),
        F.lit(generated_at).cast("string").alias("generated_at"),
        F.lit(seen[0] if seen else None).cast("bigint").alias("observed_rows"),
        F.lit(seen[1] if seen else None).cast("bigint").alias("observed_mentions"),
        F.lit(seen is None or seen == (rows, sum(mentions.values()))).alias("agrees"),
    )
