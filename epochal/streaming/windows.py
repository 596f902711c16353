"""Streaming forms of binning and sessions; each gives what the batch operator gives once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_stream(events: DataFrame, time: str, bin_seconds: int, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Events per key and bin; bins without events do not appear."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.groupBy(F.window(time, f"{bin_seconds} seconds"), *by).agg(F.count("*").alias("n"))
    return rows.select(*by, F.col("window.start").alias("start"), "n")


def support_stream(events: DataFrame, time: str, gap_seconds: int, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of events that follow each other within the gap, from the first to the last event."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.groupBy(F.session_window(time, f"{gap_seconds} seconds"), *by).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    return rows.select(*by, "start", "end", "n")


def average_stream(events: DataFrame, time: str, value: str, bin_seconds: int, slide_seconds: int, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Sliding means per key."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.groupBy(F.window(time, f"{bin_seconds} seconds", f"{slide_seconds} seconds"), *by).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return rows.select(*by, F.col("window.start").alias("start"), value, "n")
