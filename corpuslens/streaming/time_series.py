"""The time-series report over a stream: counts in event-time windows, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", group: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows (start, grp, n, total): events and their value in each window; works on streams and on tables."""
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.window(ts, window), F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "grp", "n", "total")


def run_to_table(events: DataFrame, name: str, checkpoint: str) -> None:
    """Drains a bounded stream into an in-memory table."""
    q = windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
