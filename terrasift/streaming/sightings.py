"""An extension beyond batch: sightings as a stream, with event-time windows and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, late: str = "1 day", size: str = "24 hours") -> DataFrame:
    """Sightings by kind in tumbling windows of event time; rows later than `late` are dropped by the watermark."""
    t = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def bursts(stream: DataFrame, late: str = "1 day", gap: str = "2 hours") -> DataFrame:
    """Sessions of sightings of one case without a pause of `gap`."""
    t = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return t.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
