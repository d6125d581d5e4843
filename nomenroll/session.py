"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

def local_session(
    cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-machine session for tests and timings; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nomenroll")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for name, value in SESSION_DEFAULTS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session, else one in its warehouse.

    A warehouse on a machine's own disk will do for a local master only, where driver and executors share it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir", None), spark.sparkContext.master
    one_machine = master == "local" or master.startswith("local[")
    if not warehouse or (not one_machine and re.match("file:|/", warehouse)):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{warehouse.rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    A written table survives the loss of an executor, unlike cached blocks, and its readers prune
    columns and push filters down again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(seen: Observation, name: str) -> int:
    """A count that an action has observed; 0 where there was so certainly no row that the plan was cut off above it.

    Spark then has an empty row of metrics, which it can't hand over.
    """
    try:
        return seen.get[name]
    except Py4JJavaError as error:
        if "toPyRow" not in str(error):
            raise
        return 0
