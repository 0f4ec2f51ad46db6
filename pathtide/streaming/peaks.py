"""Called peaks as a stream: removal of repeated deliveries, and counts per time window.

Deliveries come late and more than once. The watermark bounds what has to be remembered; rows later
than it are left out of windows that are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, item: str, event_time: str, delay: str) -> DataFrame:
    """The first delivery of each item; a repeat within ``delay`` of event time is dropped. Null items are items like any other."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([item])


def windowed_counts(stream: DataFrame, keys: list[str], event_time: str, width: str, delay: str) -> DataFrame:
    """Rows per key and event-time window: keys, window_start, window_end, n."""
    got = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> None:
    """Appends everything available to parquet, exactly once, and ends."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
