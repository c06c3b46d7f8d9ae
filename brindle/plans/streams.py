"""Streaming queries, replayed over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import shared_dir
from brindle.streaming import events as ev


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream, each event once, counted by day and kind; equal to the batch result."""
    found = ev.replay(ev.windowed_counts(ev.source(spark, sf)), f"{shared_dir(spark)}/brindle/stream-{uuid.uuid4().hex}", "daily")
    return found.select(F.col("window.start").cast("date").alias("day"), "event_type", "events", F.round("value", 2).alias("value"))


DAILY = "SELECT ts::DATE AS day, event_type, count(*) AS events, round(round(sum(value), 4), 2) AS value FROM events GROUP BY 1, 2"

def stream_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """Heartbeats that are pushed: when an hour passed, or what a user does changed."""
    beats = ev.source(spark, sf).select("user_id", F.date_trunc("second", "ts").alias("ts"), F.when(F.col("event_type").isin("click", "view"), "busy").otherwise(F.col("event_type")).alias("payload"))
    return ev.collected(ev.throttled(beats, 3600), f"{shared_dir(spark)}/brindle/stream-{uuid.uuid4().hex}", "beats").select("user_id", F.unix_seconds("ts").alias("second"), "payload")


HEARTBEATS = """
WITH RECURSIVE b AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS second, payload, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), payload) AS k FROM (SELECT user_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'busy' ELSE event_type END AS payload FROM events)),
w AS (SELECT user_id, k, second, payload, second AS last, payload AS held, true AS pushed FROM b WHERE k = 1
UNION ALL SELECT b.user_id, b.k, b.second, b.payload, CASE WHEN b.payload <> held OR b.second - last >= 3600 THEN b.second ELSE last END, CASE WHEN b.payload <> held OR b.second - last >= 3600 THEN b.payload ELSE held END, b.payload <> held OR b.second - last >= 3600 FROM w JOIN b ON b.user_id = w.user_id AND b.k = w.k + 1)
SELECT user_id, second, payload FROM w WHERE pushed
"""


def stream_seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a replayed stream, each id once, however often the source repeats it."""
    twice = ev.source(spark, sf)
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return ev.collected(ev.fresh_ids(twice), f"{shared_dir(spark)}/brindle/stream-{uuid.uuid4().hex}", "seen").select("event_id", "user_id", "event_type")


SEEN = "SELECT event_id, user_id, event_type FROM events"

QUERIES = {"stream_daily_counts": (stream_daily_counts, DAILY), "stream_heartbeats": (stream_heartbeats, HEARTBEATS), "stream_seen_ids": (stream_seen_ids, SEEN)}
