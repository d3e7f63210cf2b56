"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from graincask.catalog import query
from graincask.sources.tables import table
from graincask.streaming import events

_SQL = "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _shown(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total")


@query("stream_event_counts", _SQL)
def stream_event_counts(spark, sf):
    return _shown(events.run_available(events.windowed_counts(events.source(spark, sf))))


@query("batch_event_counts", _SQL)
def batch_event_counts(spark, sf):
    return _shown(events.windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
