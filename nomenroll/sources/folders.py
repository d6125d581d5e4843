"""Folders of the shared file system, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    inside = jvm.org.apache.hadoop.fs.Path(path)
    return inside, inside.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly below ``path``; none if it doesn't exist."""
    inside, system = _opened(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(inside)) if system.exists(inside) else []


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Give a finished folder its name in one step; an error if the name is taken.

    Atomic where renaming a folder is, as in HDFS and on local disks.
    """
    jvm, (inside, system) = spark.sparkContext._jvm, _opened(spark, target)
    system.mkdirs(inside.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(jvm.org.apache.hadoop.fs.Path(source), inside, none)


def remove(spark: SparkSession, path: str) -> None:
    inside, system = _opened(spark, path)
    system.delete(inside, True)
