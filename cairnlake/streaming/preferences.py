"""Preferences over a stream of events; an extension beside the batch profiles, with the same windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preference_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, user_id, event_type, n, total) of a stream (user_id, event_type, value, ts); later events than ``late`` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session, user_id, n): runs of a user's events with no pause of ``gap``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
