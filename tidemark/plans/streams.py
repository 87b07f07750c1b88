"""Streams: extensions that the batch operators suggest, run over all events at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import runs
from .registry import QUERIES, SQL


def _stream(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@_stream("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_hour_counts(spark, sf_dir):
    found = runs.last_result(runs.windowed(runs.events(spark, sf_dir), F.window("ts", "1 hour"), "event_type"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@_stream("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM s) SELECT min(ts)::TIMESTAMP AS start, user_id, count(*)::BIGINT AS n FROM i GROUP BY user_id, nth""")
def stream_sessions(spark, sf_dir):
    """Runs of a user's events with at most two hours between neighbours."""
    found = runs.last_result(runs.windowed(runs.events(spark, sf_dir), F.session_window("ts", "2 hours"), "user_id"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@_stream("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    return runs.appended(runs.first_seen(runs.events(spark, sf_dir), "user_id", "event_type"))


@_stream("SELECT user_id, max(event_id) AS event_id, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    def merge(old, batch):
        new = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
        return new if old is None else old.unionByName(new).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.sum("n").alias("n"))

    return runs.upserted(runs.events(spark, sf_dir), merge)
