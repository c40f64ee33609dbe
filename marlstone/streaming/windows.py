"""Windowed aggregates over an event stream. An extra: the inventory has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive below ``path``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, sum and mean by window and event type; rows later than the watermark are dropped by a stream.
    The same function gives the batch result of a table."""
    groups = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    out = groups.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total", "mean")
