"""Optional streaming forms of window operators: events to per-window label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_labels(events: DataFrame, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n per tumbling window; rows later than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
