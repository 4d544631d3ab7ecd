"""User preferences kept up to date from an event stream.

The reference recomputes everything from files; these are the same aggregates as streaming plans, so the
batch operators can read a maintained table instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preference_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, user_id, genre, n): events of each user and preferred label in tumbling event-time windows.

    Works on a stream (with a watermark, late events beyond it go) and on a table alike.
    """
    label = (F.get_json_object("props", "$.k").try_cast("int") % 10).cast("string")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", label.alias("genre")).filter("user_id is not null and genre is not null")
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", window), "user_id", "genre").agg(F.count("*").alias("n"))


def start(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append finished windows to a Parquet table; restarts go on from the checkpoint."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
