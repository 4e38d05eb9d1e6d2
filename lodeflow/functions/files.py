"""File-system and session helpers over Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.shared import removed  # noqa: F401  (part of this module's surface)


def cat(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file."""
    return spark.read.text(path)


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modified) of what lies at several paths; each path's own file system is asked."""
    conf, rows = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        rows += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in at.getFileSystem(conf).listStatus(at)]
    return spark.createDataFrame(rows, "path string, length long, modified long").withColumn("modified", F.timestamp_millis("modified"))


def settings(spark: SparkSession) -> DataFrame:
    """(key, value) of the session's settings."""
    return spark.createDataFrame(sorted(spark.conf.getAll.items()), "key string, value string")


def nothing(df: DataFrame) -> DataFrame:
    """No rows, with the columns of ``df``."""
    return df.limit(0)
