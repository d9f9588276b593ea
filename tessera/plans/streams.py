"""Streaming queries: each runs all available input and returns the sink's table. They extend the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import jobs


def _events(spark, sf):
    return jobs.event_stream(spark, f"{sf}/events.parquet")


def stream_usage_tumbling(spark, sf):
    out = jobs.run_available(jobs.tumbling_usage(_events(spark, sf), "event_type", "value", late="0 seconds"), "complete")
    return out.select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf):
    out = jobs.run_available(jobs.sessions(_events(spark, sf), "user_id", "6 hours"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def stream_dedup(spark, sf):
    return jobs.run_available(jobs.first_seen(_events(spark, sf).select("event_type", "user_id", "ts"), ["event_type", "user_id"])).select("event_type", "user_id")


def stream_rate_limit(spark, sf):
    return jobs.run_available(jobs.rate_limiter(_events(spark, sf), "user_id", "event_id", 3, 43_200)).select("event_id", "n", "rejected")


def stream_checkpoint_restore(spark, sf):
    """Views restore the latest purchase of their user that is at most 7 days old: a stream-stream interval join."""
    e = _events(spark, sf)
    starts, written = e.filter("event_type = 'view'").withColumnRenamed("event_id", "start_id"), _events(spark, sf).filter("event_type = 'purchase'")
    out = jobs.latest_per_start(jobs.run_available(jobs.restorable_checkpoints(starts, written, "user_id")))
    return out.select(F.col("start_id").alias("event_id"), F.unix_micros("checkpoint_at").alias("checkpoint_us"))


def stream_upsert_latest(spark, sf):
    """The last event of every user, by batches merged into a table in parts."""
    import uuid

    from tessera.session import shared_dir

    e = _events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    return jobs.upsert_index(e, f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}", "user_id", "ts").select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (stream_usage_tumbling, stream_sessions, stream_dedup, stream_rate_limit, stream_checkpoint_restore, stream_upsert_latest)}

ORACLES = {
    "stream_checkpoint_restore": "SELECT v.event_id AS event_id, epoch_us(max(p.ts)) AS checkpoint_us FROM events v JOIN events p ON p.user_id = v.user_id AND p.ts <= v.ts AND p.ts >= v.ts - INTERVAL 7 DAY WHERE v.event_type = 'view' AND p.event_type = 'purchase' GROUP BY 1",
    "stream_upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_usage_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events) SELECT user_id, cast(sum(s) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY 1",
    "stream_dedup": "SELECT DISTINCT event_type, user_id FROM events",
    "stream_rate_limit": "SELECT event_id, n, n > 3 AS rejected FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 43199999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events)",
}
