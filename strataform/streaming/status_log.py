"""Extension, not in the reference: its append-only status log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(events: DataFrame, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n): events of each type in each window of time; later ones than late are dropped by the watermark. None: events have one already."""
    counts = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without those whose id came before, as long as the watermark remembers it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
