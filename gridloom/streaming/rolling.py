"""A panel kept up to date from a stream of events: sums by id and time window, late events within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """From (id, ts, value): id, start of the window, n and total. For streams and for tables alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # of the session's time zone
    late = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = late.groupBy("id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("id", F.col("w.start").alias("start"), "n", "total")


def update_panel(stream: DataFrame, path: str, checkpoint: str):
    """Starts writing finished windows to Parquet at `path`, once all that is there has been read."""
    return windowed_sums(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
