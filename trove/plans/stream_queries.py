"""Queries that run streams over the events, and the recovery scan over all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trove.operators import recovery as W
from trove.operators import slots as S
from trove.plans.graph_queries import LOG
from trove.plans.registry import query
from trove.plans.scratch import materialise
from trove.plans.service_queries import SEGMENTS, damaged
from trove.streaming import flows


@query("stream_drain", LOG + "SELECT slot_id, max(seq) AS seq, arg_max(user_id, seq) AS user_id, arg_max(value, seq) AS value FROM log WHERE state = 'committed' GROUP BY slot_id")
def _(s, d):
    log = S.slot_log(flows.event_stream(s, d)).where("state = 'committed'")
    return flows.drain(log.select("slot_id", "seq", "user_id", "value"), "slot_id", "seq")


@query("stream_daily", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return flows.daily_counts(flows.event_stream(s, d))


@query("stream_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS began, count(*) AS n FROM n GROUP BY user_id, k")
def _(s, d):
    return flows.sessions(flows.event_stream(s, d))


@query("stream_leases")
def _(s, d):
    e = flows.event_stream(s, d)
    return flows.lease_stream(e.select(F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("event_id").alias("at"), F.col("event_type").alias("holder"), (F.col("event_id") + 100).alias("expires")))


@query("recover_scan", SEGMENTS + "SELECT health, count(*) AS n, min(event_id) AS first_epoch FROM k GROUP BY 1")
def _(s, d):
    """Every event written as a stored row in range partitions, damaged, and recovered segment by segment."""
    back = W.recover(materialise(damaged(s, d).repartitionByRange("event_id"), "scan"), "segment", "slot", 400)
    return back.groupBy("health").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_epoch"))
