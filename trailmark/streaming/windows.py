"""Event-time windows and dedup that run on batch and streaming DataFrames alike (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import zoned


def prepared(events: DataFrame, late: str | None = None) -> DataFrame:
    """Timestamps as instants; on a stream with a watermark of ``late``."""
    events = zoned(events)
    return events.withWatermark("ts", late) if events.isStreaming and late else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of windows side by side."""
    return _windowed(prepared(events, late), F.window("ts", width))


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of windows that overlap."""
    return _windowed(prepared(events, late), F.window("ts", width, step))


def _windowed(events: DataFrame, window) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")  # whole numbers, so that no order of adding matters
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n): events of a user no further apart than ``gap``."""
    out = prepared(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("last").cast("timestamp_ntz").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once: within the watermark on a stream, over everything in a batch."""
    events = prepared(events, late)
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
