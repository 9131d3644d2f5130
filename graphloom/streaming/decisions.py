"""Streams of review decisions and activity: an extension, over what batch queries read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_decisions(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The latest decision per item of a stream (item, decision, ts, ord): run it in update mode."""
    return events.withWatermark("ts", lateness).groupBy("item").agg(F.max_by("decision", F.struct("ts", "ord")).alias("decision"), F.max("ts").alias("updated_at"))


def activity(events: DataFrame, every: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window of a stream (event_type, ts, value)."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions per item of a stream (item, ts), closed after a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "item").agg(F.count("*").alias("n")).select("item", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
