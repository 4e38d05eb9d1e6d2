"""Readers: lines, delimited, fixed-width and ragged records, edge lists, file names, and several inputs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions import exprs


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): text lines; globs and compressed files (by their ending) are read, too."""
    return spark.read.text(path)


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(offset, value): lines with the place of their first byte in the file, which Spark's text source doesn't give."""
    base = "org.apache.hadoop"
    rdd = spark.sparkContext.newAPIHadoopFile(path, f"{base}.mapreduce.lib.input.TextInputFormat", f"{base}.io.LongWritable", f"{base}.io.Text")
    return rdd.toDF("offset long, value string")


def named(df: DataFrame) -> DataFrame:
    """``df`` of a file source with file_name, file_path and the name's parts between ``-`` and ``.``."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path")).withColumn("file_parts", F.split("file_name", r"[-.]"))


def fields(line: Column, separator: str) -> Column:
    """The fields of a line; empty ones at its end are dropped."""
    return F.split(F.regexp_replace(line, rf"(?:{separator})+$", ""), separator)


def delimited(df: DataFrame, columns: dict[str, tuple[int, str]], *, separator: str = "\t", line: str = "value") -> DataFrame:
    """Columns (place from 0, type) of delimited lines; null where a field is missing or doesn't parse."""
    parts = F.split(F.col(line), separator)
    return df.select(*(F.get(parts, F.lit(at)).try_cast(kind).alias(name) for name, (at, kind) in columns.items()))


def stations(df: DataFrame, *, line: str = "value") -> DataFrame:
    """(id, lat, lng) of tab-separated lines; the place stands at 9 in lines of 11 fields, at 10 in others."""
    parts = fields(F.col(line), "\t")
    at = F.when(F.size(parts) == 11, 9).otherwise(10)
    return df.select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, at).try_cast("double").alias("lat"), F.get(parts, at + 1).try_cast("double").alias("lng"))


def edges(df: DataFrame, *, line: str = "value") -> DataFrame:
    """(id1, id2) of ``id1 id2`` lines; empty lines and those that start with % are comments."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    kept = df.where((F.trim(F.col(line)) != "") & ~F.col(line).startswith("%"))
    return kept.select(F.get(parts, F.lit(0)).try_cast("long").alias("id1"), F.get(parts, F.lit(1)).try_cast("long").alias("id2"))


def weather(df: DataFrame, *, line: str = "value") -> DataFrame:
    """The fields of weather records with their station's id; lines that are too short go."""
    kept = df.where(F.length(line) > exprs.WEATHER_LONGER_THAN)
    out = kept.select(*exprs.fixed_width(F.col(line), exprs.WEATHER))
    return out.withColumn("station", exprs.station_id(F.col("usaf"), F.col("wban")))


def weather_cells(df: DataFrame, *, line: str = "value") -> DataFrame:
    """(lat, lng, year, month, station, day) as text of weather records with a temperature: whole degrees, minus and zeros kept."""
    cut = lambda a, b: F.substring(line, a + 1, b - a)
    degrees = lambda a, b: F.replace(cut(a, b), F.lit("+"), F.lit(""))
    out = [degrees(28, 31).alias("lat"), degrees(34, 38).alias("lng"), cut(15, 19).alias("year"), cut(19, 21).alias("month"), cut(4, 15).alias("station"), cut(21, 23).alias("day")]
    return df.where(exprs.reading_there(F.col(line))).select(*out)


def page_counts(df: DataFrame, *, line: str = "value", file_name: str = "file_name") -> DataFrame:
    """(project, page, views, bytes, hour) of page-count lines; the hour is the third part of the file's name."""
    parts = F.split(F.col(line), r"\s")
    own = [F.get(parts, F.lit(0)).alias("project"), F.get(parts, F.lit(1)).alias("page"), F.get(parts, F.lit(2)).try_cast("long").alias("views"), F.get(parts, F.lit(3)).try_cast("long").alias("bytes")]
    return df.select(*own, F.get(F.split(F.col(file_name), r"[-.]"), F.lit(2)).alias("hour"))


def access_log(df: DataFrame, *, line: str = "value") -> DataFrame:
    """(user, product) of log lines with hexadecimal ids in the third and fourth field."""
    parts = F.split(F.col(line), " ")
    return df.select(exprs.hex_number(F.get(parts, F.lit(2))).alias("user"), exprs.hex_number(F.get(parts, F.lit(3))).alias("product"))


def several(inputs: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """Inputs, each with its own mapping to common columns, as one."""
    first, *rest = [df.select(*mapping) for df, mapping in inputs]
    for other in rest:
        first = first.unionByName(other)
    return first
