"""Windowed counts over a stream of events. An extra: nothing in the map operators streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total): counts and sums of ``value`` by window and key; events later than ``late`` are dropped.

    Works on a stream, where the watermark bounds the state, and on a table alike.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    counted = events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): runs of a key's events without a gap as long as ``gap``."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
