"""Streaming counts per interval and bounded-state deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(stream: DataFrame, event_time: str, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Drop repeats that arrive within the delay; later ones are caught by the log's id check."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def arrivals_per_interval(stream: DataFrame, event_time: str, interval: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, interval).alias("w")).agg(
        F.count("*").alias("arrivals")
    ).select(F.col("w.start").alias("window_start"), "arrivals")


def queue_latency(outcomes: DataFrame) -> DataFrame:
    """Seconds between enqueueing and the final outcome."""
    return outcomes.withColumn("queue_sec", F.col("finished_sec") - F.col("enqueued_sec"))
