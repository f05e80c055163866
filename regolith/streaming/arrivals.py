"""Scene arrivals as a stream: an extension, the batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrivals(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Scenes by kind and window of event time, from events(ts, event_type, value), with a watermark for late ones."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("scenes"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "scenes", "total")
    )
