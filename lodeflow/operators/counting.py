"""Counts of keys and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column, pattern: str = r"\s+") -> Column:
    """The non-empty pieces of ``text`` between matches of ``pattern``; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def token_count(df: DataFrame, text: str, *, pattern: str = r"\s+") -> DataFrame:
    """(word, n) of all tokens; counts are combined before the exchange."""
    return df.select(F.explode(tokens(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
