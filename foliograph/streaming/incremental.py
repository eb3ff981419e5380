"""Streams: windows and sessions over events, and idempotent upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """(event_type, start, n, total) by tumbling window; with ``lateness`` a watermark bounds the state of a stream."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of sessions that a pause of ``gap`` ends."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(stream: DataFrame, checkpoint: str, each) -> None:
    """Process what is there, batch by batch; ``each(frame, batch_id)`` must be idempotent by batch_id."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
