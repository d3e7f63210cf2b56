"""Structured Streaming over the events table: windowed counts with a watermark, and duplicates within it. An extension; nothing here has a batch-free counterpart to match."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "2 hours"


def source(spark: SparkSession, folder: str, glob: str = "events.parquet*") -> DataFrame:
    """The events as a stream; the event time becomes a timestamp, which watermarks need."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, for a stream or a table; rows later than LATE are dropped from a stream."""
    timed = events.withWatermark("ts", LATE) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_seen(events: DataFrame) -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into a table of results (windows × types), and returns it."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
