"""Streaming forms of the batch aggregates: what is there is read once in small batches, and ends equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.shared import shared_dir, stored


def final_state(spark: SparkSession, path: str, schema: str | object, aggregate, *, files: int = 16) -> DataFrame:
    """The last state of ``aggregate`` (frame to aggregated frame) over a folder or file of Parquet, as a stream."""
    folder, _, name = path.rpartition("/")
    path = f"{folder}/{{{name}}}"  # a pattern may name a single file, a plain path may not
    out, at = f"{shared_dir(spark)}", shared_dir(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last[:] = [number]

    query = aggregate(source).writeStream.outputMode("complete").option("checkpointLocation", at).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/{last[0]}") if last else stored(aggregate(spark.read.schema(schema).parquet(path)))


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by event time; rows later than the watermark don't change windows that are closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
