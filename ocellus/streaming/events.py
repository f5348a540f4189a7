"""Windowed quality counts of an event stream, late rows within the watermark included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, mean and low (the smallest value) of each window; ``events``: ts, event_type, value; a stream or a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    got = rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "mean", "low")
