"""Event-time windows over a stream of event files; the batch forms are the catalogue's window queries.

State is bounded by the watermark: a window is emitted once, when the watermark has passed its end, and its state goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as they arrive in a folder, with event time as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_totals(events: DataFrame, size: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Count and sum per window and event type."""
    window = F.window("ts", size)
    grouped = events.withWatermark("ts", lateness).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Events per user and session."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
