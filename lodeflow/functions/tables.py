"""Reading the named Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder, through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of text to a task, so that what it combines stays in memory.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df`` over all cores: a table whose files give fewer splits than there are cores is dealt anew, any other is as it is.

    For work that costs much for each row. Such a table is small, at most a split for each core; a large one never moves, unless
    ``text`` names a column: then there are as many tasks as its bytes need, for work whose memory grows with a task's text.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if text is not None:
        wanted = max(wanted, (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // TASK_BYTES + 1)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
