"""Structured Streaming: watermarked windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling window and key; runs on a stream (state bounded by the watermark) or a table."""
    stamped = events.withColumn("__ts", F.col(time).cast("timestamp"))
    own = stamped.withWatermark("__ts", late) if events.isStreaming else stamped
    return own.groupBy(F.window("__ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
