"""Latest value of each slot over a stream: an extension of the batch operators, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Newest value of each user and event type so far; run with output mode update or complete."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    value = (F.floor("value").cast("long") % 7).cast("string")
    return events.groupBy("user_id", "event_type").agg(F.max_by(value, F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n_versions"))


def windowed_counts(events: DataFrame, width: str = "1 day", watermark: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").count()
