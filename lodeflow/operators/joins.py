"""Joins of differently mapped inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators import aggregates


def histogram_join(prices: DataFrame, stations: DataFrame, key: str, *, width: int = 10) -> DataFrame:
    """Price histograms by station with its place; 0, 0 where the station isn't known, the greatest place where it is repeated.

    ``prices`` has (key, price), ``stations`` (key, lat, lng). The prices are aggregated before the join.
    """
    hist = aggregates.histograms(prices, key, F.floor(F.col("price") / width).cast("long"))
    places = stations.groupBy(key).agg(F.max(F.struct("lat", "lng")).alias("at"))
    return hist.join(places, key, "left").select(key, *(F.coalesce(F.col(f"at.{c}"), F.lit(0.0)).alias(c) for c in ("lat", "lng")), "histogram")


def cogrouped(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, a, b, both): sums of two inputs' values by key, and both as text; keys of either input stay."""
    a = left.groupBy(key).agg(F.sum("value").alias("a"))
    b = right.groupBy(key).agg(F.sum("value").alias("b"))
    return a.join(b, key, "full_outer").select(key, "a", "b", F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).alias("both"))
