"""The event operators over streams: watermarked windows, sessions, signals per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgraph.operators import align


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, end, event_type, n, total by event time; later rows than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: runs of events without a gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def aligned(events: DataFrame, offsets: DataFrame, key: str = "user_id") -> DataFrame:
    """A stream with its clock offsets applied, joined with a static table."""
    return align.apply_offset(events, offsets, key)
