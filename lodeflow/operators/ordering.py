"""Orders within keys that hold when one key has most of the rows.

Rows are ranged by (key, order), so a large key is spread over many tasks; each task numbers its part, and the parts' sizes,
one number for each key and task, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.shared import free_name, stored


def positions(df: DataFrame, key: str, order: list[str], *, as_name: str = "position", size: str | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) within its key; ``size`` names a column for the key's number of rows.

    Helper columns get names that ``df`` doesn't have; a column named as the result is replaced.
    """
    part, own = free_name(df.columns, "part"), free_name(df.columns, "own")
    k, p, n, before, every = (free_name([*df.columns, part, own], c) for c in ("k", "p", "n", "before", "every"))
    ranged = stored(df.repartitionByRange(key, *order).withColumn(part, F.spark_partition_id()))
    parts = ranged.groupBy(F.col(key).alias(k), F.col(part).alias(p)).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(k).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(k, p, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before), F.sum(n).over(Window.partitionBy(k)).alias(every))
    at = F.row_number().over(Window.partitionBy(key, part).orderBy(*order))
    out = ranged.withColumn(own, at).join(parts, F.col(key).eqNullSafe(F.col(k)) & (F.col(part) == F.col(p)))
    named = {as_name.lower(), (size or as_name).lower()}
    return out.select(*(c for c in df.columns if c.lower() not in named), (F.col(own) + F.col(before)).cast("long").alias(as_name), *([F.col(every).alias(size)] if size else []))


def secondary_sort(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with their position in the key's order: key and position say where each stands."""
    return positions(df.select(key, *order), key, order)


def per_key_sample(df: DataFrame, key: str, item: str, *, share: float = 0.1) -> DataFrame:
    """A share of each key's rows, one at least: those whose item has the least MD5."""
    drawn = positions(df.select(key, item, F.md5(F.col(item).cast("string")).alias("_draw")), key, ["_draw", item], as_name="_at", size="_n")
    return drawn.where(F.col("_at") <= F.greatest(F.lit(1), F.floor(share * F.col("_n") + 0.5))).select(key, item)


def with_markers(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, y, marker): a row for each group, y -1, and all of its rows."""
    rows = df.select(key, value.cast("long").alias("y"), F.lit(False).alias("marker"))
    return rows.unionByName(df.select(key).distinct().select(key, F.lit(-1).cast("long").alias("y"), F.lit(True).alias("marker")))
