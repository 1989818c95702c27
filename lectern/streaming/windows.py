"""Event-time windows, the same code for batch and stream. An extension; late events wait for DELAY."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "1 hour"


def timed(events: DataFrame) -> DataFrame:
    """Timestamps without a zone are UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _late(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", DELAY) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _late(timed(events)).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "24 hours", step: str = "1 hour") -> DataFrame:
    return _late(timed(events)).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return _late(timed(events)).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once; in a stream repeats are recognised within DELAY."""
    events = timed(events)
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
