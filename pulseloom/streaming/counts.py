"""Streams: event histograms and threshold crossings as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """(start, key, n) over tumbling windows; a window is final once the watermark has passed it."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def crossings(events: DataFrame, threshold: float, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Events over a threshold, each id once within the watermark."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.where(F.col("value") > threshold).dropDuplicatesWithinWatermark(["event_id"]).select(key, "event_id", "ts", "value")
