"""Hourly counts over a stream of events (beyond the batch engine): late events count until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(hour, cnt) of a streaming frame with a timestamp column."""
    timed = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 hour").alias("w")).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("hour"), "cnt")
