"""Streaming shapes, replayed as batches over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dedupe
from tessera.plans.registry import query
from tessera.session import load
from tessera.streaming.windows import session_counts, tumbling_counts


@query("""
WITH e AS (SELECT user_id, ts, (coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 30 * 60000, true))::INTEGER AS b, event_id FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return session_counts(events, "user_id", "ts", "30 minutes").select("user_id", "session_start", "n_events")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return tumbling_counts(events, "ts", "1 hour", "event_type").select("window_start", "event_type", "n")


@query("""
SELECT user_id, arg_min(event_id, (age, -epoch_ms(ts), event_id)) AS event_id FROM (SELECT *, (ts < TIMESTAMP '2024-01-20')::INTEGER AS age FROM events) GROUP BY 1""")
def upsert_feed(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    cut = F.lit("2024-01-20").cast("timestamp")
    latest = dedupe.upsert(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), ["user_id"], [-F.unix_millis("ts"), F.col("event_id")])
    return latest.select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02')")
def incremental_unseen(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    old = events.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp")).select("user_id")
    return dedupe.unseen(events, old, ["user_id"]).select("event_id")


@query("SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k_sum, count(props::JSON ->> '$.k') AS n_k FROM events GROUP BY 1")
def json_props_extract(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return events.groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(k).alias("n_k"))
