"""Extensions over event streams: progress by key, expiry, and sessions, with watermarks that bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(events: DataFrame, key: str, at: str, columns: list[str], late: str = "1 hour") -> DataFrame:
    """The newest record of each key within hourly windows that late records can still reach."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour"), key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("last"), F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of records of a key that no gap parts."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def live(events: DataFrame, at: str, ttl: str, late: str = "1 hour") -> DataFrame:
    """Records of a stream once each, forgotten when their time to live is over."""
    return events.withWatermark(at, late).withColumn("expires_at", F.col(at) + F.expr(f"interval {ttl}")).dropDuplicatesWithinWatermark(["event_id"])
