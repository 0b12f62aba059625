"""Slot states, gap watermarks, leases, projections and rates from event frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ["claimed", "committed", "released", "unreserved"]


def slot_log(events: DataFrame) -> DataFrame:
    """(slot_id, seq, state, user_id, value): the events as steps of slots, four to a slot, every seventh one missing."""
    slot = F.floor(F.col("event_id") / 4)
    state = F.element_at(F.array(*[F.lit(s) for s in ("claimed", "committed", "committed", "released")]), (F.col("event_id") % 4 + 1).cast("int"))
    drop = F.col("event_id") % 7 != 3
    return events.where(drop).select(slot.alias("slot_id"), F.col("event_id").alias("seq"), state.alias("state"), "user_id", "value")


def latest_state(log: DataFrame) -> DataFrame:
    """(slot_id, state, seq): the last step of each slot, folded map-side."""
    return log.groupBy("slot_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def state_counts(log: DataFrame, spark: SparkSession) -> DataFrame:
    """(state, n) for every known state, zero included."""
    known = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = latest_state(log).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return known.join(F.broadcast(counts), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def gap_watermark(slots: DataFrame, total: str = "slot_id") -> DataFrame:
    """One row: how many slots from 0 on are committed or released without a gap; missing slots are gaps."""
    done = slots.where(F.col("state").isin("committed", "released")).select("slot_id")
    # the first number whose successor is missing: a self-join by equality, not a window over all slots
    after = done.join(done.select((F.col("slot_id") - 1).alias("slot_id")), "slot_id", "left_anti")
    both = done.agg(F.min("slot_id").alias("low"), F.lit(None).cast("long").alias("last")).union(after.agg(F.lit(None).cast("long"), F.min("slot_id")))
    return both.agg(F.when(F.max("low") == 0, F.max("last") + 1).otherwise(0).cast("long").alias("watermark"))


def project(log: DataFrame) -> DataFrame:
    """Last committed step of each slot: slot_id, seq, user_id, value."""
    done = log.where(F.col("state") == "committed").groupBy("slot_id").agg(F.max_by(F.struct("seq", "user_id", "value"), "seq").alias("r"))
    return done.select("slot_id", "r.*")


def active_leases(claims: DataFrame, now: int) -> DataFrame:
    """(path, holder, expires): the latest claim of each path that is still running at ``now``."""
    last = claims.groupBy("path").agg(F.max_by(F.struct("holder", "expires"), "at").alias("r"))
    return last.select("path", "r.holder", "r.expires").where(F.col("expires") > now)


def sequence_gaps(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, breaks, first_seq, last_seq, n): successors further than one apart within each group."""
    order = Window.partitionBy(group).orderBy(seq)
    marked = rows.withColumn("_before", F.lag(seq).over(order))
    return marked.groupBy(group).agg(F.count_if(F.col(seq) - F.col("_before") > 1).alias("breaks"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("n"))


def index_percentiles(rows: DataFrame, value: str, points: list[tuple[str, float]]) -> DataFrame:
    """One row: n, mean and exact percentiles, aggregated from counts of distinct values."""
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in points]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), *exact)


def ring_read(rows: DataFrame, seq: str, at: int, capacity: int) -> DataFrame:
    """One row: outcome (empty, lagging, ok) of reading place ``at`` of a ring that keeps the last ``capacity`` rows, and the row's value."""
    head = F.max(seq) + 1
    found = F.max(F.when(F.col(seq) == at, F.col("value")))
    outcome = F.when(F.lit(at) >= head, "empty").when(F.lit(at) < head - capacity, "lagging").otherwise("ok")
    return rows.agg(outcome.alias("outcome"), F.when(outcome == "ok", found).alias("value"))


def ring_latest(rows: DataFrame, seq: str) -> DataFrame:
    """The last row of a ring."""
    best = rows.agg(F.max_by(F.struct(*rows.columns), seq).alias("r"))
    return best.select("r.*")


def push_outcome(head: Column, least_reader: Column, capacity: int) -> Column:
    """accepted, or full where the slowest reader would lose a row."""
    return F.when(head >= least_reader + capacity, "full").otherwise("accepted")
