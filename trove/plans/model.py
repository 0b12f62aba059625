"""Views of the record model over the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.plans.tables import table

#: Event types in sorted order; a record's opcode is 1001 plus the place.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SPOKES = 10


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact records from events: slot_id, opcode, subject_id, predicate_id, target_id, flags, epoch, ts, value, status."""
    ev = table(spark, sf_dir, "events")
    opcode = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) + 1000
    return ev.select(
        F.col("event_id").alias("slot_id"),
        opcode.cast("long").alias("opcode"),
        F.col("user_id").alias("subject_id"),
        F.col("event_type").alias("predicate_id"),
        F.get_json_object("props", "$.k").cast("long").alias("target_id"),
        F.when(F.col("event_id") % 2 == 1, 1).otherwise(2).cast("long").alias("flags"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("epoch"),
        "ts",
        "value",
        F.when(F.col("event_id") % 16 == 5, "tombstone").when(F.col("event_id") % 16 == 11, "leased").otherwise("committed").alias("status"),
    )


def spoked(rows: DataFrame, spokes: int = SPOKES) -> DataFrame:
    """Add the partition number of a record, derived from its subject."""
    return rows.withColumn("spoke", F.pmod("subject_id", F.lit(spokes)).cast("long"))


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking candidates: events folded by user, joined with the vector of the same number.

    key, class_key, last_us (microseconds), access_count, hop, embedding, fp (48 signed bytes).
    """
    ev = table(spark, sf_dir, "events")
    use = ev.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_ts"))
    em = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("long").alias("class_key"), "embedding")
    fp = F.transform(F.slice("embedding", 1, 48), lambda x: F.greatest(F.least(F.round(x.cast("double") * 127), F.lit(127.0)), F.lit(-128.0)).cast("tinyint"))
    out = use.join(em, "key").withColumn("last_us", F.unix_micros(F.col("last_ts").cast("timestamp")))
    return out.select("key", "class_key", "last_us", "access_count", (F.col("key") % 6).alias("hop"), "embedding", fp.alias("fp"))
