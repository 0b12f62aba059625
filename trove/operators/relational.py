"""Joins by order and by range, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Left rows with the value of the last right row of the same key at or before their time (null if none).

    Both sides are laid together once and the last known value is carried forward within each key: one shuffle, no pairs.
    """
    rows = left.select(by, at, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    known = right.select(by, at, F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(known).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return out.select("_l.*", F.col("_v").alias(value))


def range_join(points: DataFrame, point: str, spans: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with the spans [low, high) that hold them.

    Spans are copied to each bucket of ``width`` that they touch, points fall in one; the join is by equality of the
    bucket, so Spark shuffles (or broadcasts a small side) instead of comparing all pairs.
    """
    first, last = F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)
    spread = spans.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    placed = points.withColumn("_bucket", F.floor(F.col(point) / width).cast("long"))
    return placed.join(spread, "_bucket").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def sessions(rows: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """(by, session, n, first, last): runs of a key whose neighbours are at most ``gap`` apart, in the unit of ``at``."""
    order = Window.partitionBy(by).orderBy(at)
    fresh = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    marked = rows.withColumn("_new", fresh)
    numbered = marked.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
