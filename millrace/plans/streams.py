"""Queries that work their input off as a stream, each with the SQL over the whole table it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..io import scratch, table
from ..streaming import live
from .reference import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]


def _events(spark, d):
    schema = table(spark, d, "events").schema
    # as a pattern, since the source takes the name of a single file for a folder
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("at", F.col("ts").cast("timestamp"))


def _settled(spark, stream, keys):
    path = scratch(spark, "stream")
    return live.settled(stream, keys, f"{path}/rows", f"{path}/checkpoint")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, d):
    """Tumbling windows under a watermark, as they stand once all events are in."""
    w = live.windowed_counts(_events(spark, d), "at", "60 days", "1 hour", None, ["event_type"])
    return _settled(spark, w, ["start", "event_type"]).withColumn("start", F.unix_micros("start"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    """Each user and type once, however often it comes."""
    s = live.first_seen(_events(spark, d).select("user_id", "event_type", "at"), "at", "60 days", ["user_id", "event_type"])
    return _settled(spark, s, ["user_id", "event_type"]).select("user_id", "event_type")


@query("""WITH n AS (SELECT user_id, event_type = 'view' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) SELECT user_id::VARCHAR AS user_id, coalesce(min(n) FILTER (WHERE NOT f), count(*) + 1) - 1 AS streak FROM n GROUP BY 1""")
def stream_streaks(spark, d):
    """Views in a row at the end of each user's events, from one number of state a user."""
    e = _events(spark, d).select(F.col("user_id").cast("string").alias("user_id"), "at", (F.col("event_type") == "view").alias("f"))
    return _settled(spark, live.running_streaks(e, "user_id", "at", "f"), ["user_id"])
