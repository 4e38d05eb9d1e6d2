"""Sparse matrices as (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(m: DataFrame) -> DataFrame:
    """One entry for each place; explicit zeros go."""
    return m.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product; entries are summed before the join, and the join's products before their exchange."""
    a = summed(left).select(F.col("row"), F.col("col").alias("k"), F.col("value").alias("a"))
    b = summed(right).select(F.col("row").alias("k"), F.col("col"), F.col("value").alias("b"))
    return a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
