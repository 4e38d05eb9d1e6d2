"""Sinks: tab-separated text, several outputs of one frame, sequence files and files named by a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.shared import stored


def tsv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """All columns with tabs between; ``one_file`` for small results only."""
    (df.coalesce(1) if one_file else df).write.option("sep", "\t").option("emptyValue", "").csv(path)


def by_bucket(df: DataFrame, path: str, bucket: Column, *, name: str = "bucket") -> None:
    """Files in a folder for each value of ``bucket``."""
    df.withColumn(name, bucket).write.partitionBy(name).parquet(path)


def sequence(df: DataFrame, path: str) -> None:
    """Two columns as keys and values of sequence files, which only Hadoop's writer makes."""
    df.rdd.map(tuple).saveAsSequenceFile(path)


def read_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.sparkContext.sequenceFile(path).toDF(schema)


def several(df: DataFrame, path: str, *, key: str, value: str, buckets: int = 10) -> DataFrame:
    """One frame of a whole-number key as text, as sequence files and by bucket below ``path``; it is computed once."""
    rows = stored(df.select(F.col(key).cast("long"), F.col(value).cast("string")))
    tsv(rows, f"{path}/text")
    sequence(rows, f"{path}/seq")
    by_bucket(rows, f"{path}/sec", F.pmod(F.col(key), F.lit(buckets)))
    return rows
