"""Cohort counts over a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, by: str, value: str, least: float, window: str = "1 day", late: str = "2 days", time: str = "ts") -> DataFrame:
    """Events, and those of at least least, of each window and group. Works on a stream and on a batch alike."""
    # a watermark needs an instant; wall-clock times are read in the session's time zone
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), F.col(by)).agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.col(value) >= least, F.lit(False))).alias("eligible"), F.approx_count_distinct("user_id").alias("about_users"))
    return out.select(F.col("w.start").alias("window_start"), by, "events", "eligible", "about_users")
