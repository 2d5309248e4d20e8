"""Windowed aggregates over event records, for batch frames and streams alike, and a resumable log stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _late(events: DataFrame, late: str | None) -> DataFrame:
    """Watermarks need a time with a zone; the session's zone is taken."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; `late` sets the watermark of a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _late(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of a user with less than `gap` between neighbours."""
    return _late(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """First arrival of each event id within the watermark."""
    return _late(events, late).dropDuplicatesWithinWatermark(["event_id"])


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 10) -> DataFrame:
    """Parquet files of a growing folder as a stream; each file once, which is what a resume set does in batch form."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
