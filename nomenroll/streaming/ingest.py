"""Extraction and running quality counts over a stream of corpus files.

Each micro-batch writes below its own ``batch=<id>`` and overwrites it when it is replayed, so
after any restart the tables hold every row once. Progress is the checkpoint's business.

Each batch also leaves a row of the run's record: rows and mentions as they were observed on their way into the tables,
beside those that the committed tables hold. Spark's own progress reports can be recorded next to them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nomenroll.operators.rules import RULES, Rule, RuleSettings, rule_rank, with_rules
from nomenroll.plans.extraction import inventory_of
from nomenroll.plans.quality import with_context
from nomenroll.session import observed
from nomenroll.streaming.compaction import read_marked


def _write_batch(df: DataFrame, out_dir: str, table: str, batch_id: int) -> DataFrame:
    path = f"{out_dir}/{table}/batch={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _observed_batch(df: DataFrame, out_dir: str, table: str, batch_id: int) -> tuple[DataFrame, int]:
    """The written batch, and how many rows passed on their way to it."""
    seen = Observation(f"{table}-{batch_id}")
    table_rows = _write_batch(df.observe(seen, F.count(F.lit(1)).alias("rows")), out_dir, table, batch_id)
    return table_rows, observed(seen, "rows")


TASKS_PER_CORE = 2
RUN_SCHEMA = "batch_id long, rows_observed long, rows_committed long, mentions_observed long, mentions_committed long"


def batch_entities(inventory: DataFrame) -> DataFrame:
    """Distinct entities per context with their ``mentions``: rules depend on nothing else, so each is checked once."""
    return with_context(inventory).groupBy("context", "entity").agg(F.count("*").alias("mentions"))


def batch_totals(checked: DataFrame) -> DataFrame:
    flagged = F.coalesce(F.sum(F.when(F.col("_qc_flag"), F.col("mentions"))), F.lit(0))
    return checked.groupBy("context").agg(F.sum("mentions").alias("rows_total"), flagged.alias("rows_flagged"))


def batch_rule_counts(checked: DataFrame) -> DataFrame:
    return (
        checked.select("context", "mentions", F.explode("_qc_rules").alias("rule"))
        .groupBy("context", "rule")
        .agg(F.sum("mentions").alias("rows"))
    )


def start_extraction(
    stream: DataFrame,
    key: Sequence[str],
    annotate_batch: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint: str,
    count_rules: bool = False,
    settings: RuleSettings = RuleSettings(),
    rules: Sequence[Rule] = RULES,
    aliases: Mapping[str, str] | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write ``processed``, ``inventory``, ``runs`` and, if asked for, ``totals`` and ``rule_counts`` per micro-batch.

    ``annotate_batch`` turns a corpus frame into key, title, link and span columns; it may use any
    annotator, windows included, as it sees an ordinary DataFrame. It runs once per batch: the
    other tables are made from the processed rows just written. Rows are dealt out by key before: a batch
    may be a few large files, and a file one row group, which would leave most cores idle.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE, *key)
        processed, rows = _observed_batch(annotate_batch(batch), out_dir, "processed", batch_id)
        inventory, mentions = _observed_batch(inventory_of(processed, key, aliases), out_dir, "inventory", batch_id)
        record = [(batch_id, rows, processed.count(), mentions, inventory.count())]
        _write_batch(batch.sparkSession.createDataFrame(record, RUN_SCHEMA).coalesce(1), out_dir, "runs", batch_id)
        if count_rules:
            checked = with_rules(batch_entities(inventory), settings=settings, rules=rules)
            _write_batch(batch_totals(checked), out_dir, "totals", batch_id)
            _write_batch(batch_rule_counts(checked), out_dir, "rule_counts", batch_id)

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_table(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """All batches of one table, compacted or not."""
    return read_marked(spark, out_dir, table)


def record_progress(query: StreamingQuery, out_dir: str, spark: SparkSession) -> None:
    """Write what Spark has reported of the last batches (``recentProgress``) to the table ``progress``.

    A batch that is recorded again overwrites its row. Reports without rows, of a query that waits, aren't recorded.
    """
    rows = {}
    for report in query.recentProgress:
        if report.numInputRows:
            rows[report.batchId] = (report.batchId, str(report.runId), report.numInputRows, report.batchDuration)
    for batch_id, row in rows.items():
        frame = spark.createDataFrame([row], "batch_id long, run_id string, input_rows long, milliseconds long")
        _write_batch(frame.coalesce(1), out_dir, "progress", batch_id)


def run_record(spark: SparkSession, out_dir: str) -> DataFrame:
    """A row per batch: rows and mentions observed and committed, rows that Spark reported, and whether they agree.

    A batch without a report (``input_rows`` null) agrees if the other counts do.
    """
    runs = read_table(spark, out_dir, "runs")
    reported = read_table(spark, out_dir, "progress").select("batch_id", "input_rows")
    agrees = (
        (F.col("rows_observed") == F.col("rows_committed"))
        & (F.col("mentions_observed") == F.col("mentions_committed"))
        & F.coalesce(F.col("input_rows") == F.col("rows_committed"), F.lit(True))
    )
    return runs.join(reported, "batch_id", "left").withColumn("agrees", agrees)


def running_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows, flagged and clean per context, summed over all batches so far."""
    return (
        read_table(spark, out_dir, "totals")
        .groupBy("context")
        .agg(F.sum("rows_total").alias("rows_total"), F.sum("rows_flagged").alias("rows_flagged"))
        .withColumn("rows_clean", F.col("rows_total") - F.col("rows_flagged"))
    )


def running_rule_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows per context and rule, and per rule over all contexts (``overall``)."""
    context, rule = F.col("context"), F.col("rule")
    return (
        read_table(spark, out_dir, "rule_counts")
        .groupingSets([[context, rule], [rule]], context, rule)
        .agg(F.grouping("context").alias("g"), F.sum("rows").alias("rows"))
        .select("context", (F.col("g") == 1).alias("overall"), rule_rank(rule).alias("rank"), "rule", "rows")
    )
