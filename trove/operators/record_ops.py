"""Record queries and changes as transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE = "committed"
WRAP = 2**32


def scan_all(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Committed records in slot order; ``limit`` is the optional compatibility cap."""
    out = rows.where(F.col("status") == LIVE).orderBy("slot_id")
    return out if limit is None else out.limit(limit)


def point_lookup(rows: DataFrame, subject: int) -> DataFrame:
    """All committed versions of a subject."""
    return rows.where((F.col("subject_id") == subject) & (F.col("status") == LIVE))


def scan_subject(rows: DataFrame, subject: int) -> DataFrame:
    """A subject's records, deleted ones included."""
    return rows.where((F.col("subject_id") == subject) & F.col("status").isin(LIVE, "tombstone"))


def scan_opcode(rows: DataFrame, opcode: int) -> DataFrame:
    """Committed records of an opcode."""
    return rows.where((F.col("opcode") == opcode) & (F.col("status") == LIVE))


def multi_constraint(rows: DataFrame, subject: int, epoch: int, flag: int = 1) -> DataFrame:
    """A subject's records from an epoch on that carry a flag."""
    return rows.where((F.col("subject_id") == subject) & (F.col("epoch") >= epoch) & (F.col("flags").bitwiseAND(flag) != 0))


def early_exit(rows: DataFrame, subject: int, n: int = 10) -> DataFrame:
    """The first n records of a subject by slot."""
    return rows.where(F.col("subject_id") == subject).orderBy("slot_id").limit(n)


def count_opcode(rows: DataFrame, opcode: int) -> DataFrame:
    """Number of records of an opcode; no rows are moved, only counts."""
    return rows.agg(F.count_if(F.col("opcode") == opcode).alias("n"))


def batch_lookup(rows: DataFrame, keys: DataFrame, most_keys: int = 500_000) -> DataFrame:
    """Records of many subjects at once: one join, broadcast while the keys' number is within its bound."""
    small = keys.select("subject_id").distinct()
    small = F.broadcast(small) if small.limit(most_keys + 1).count() <= most_keys else small
    return rows.join(small, "subject_id", "left_semi")


def insert_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Append; flags default to 0 and epoch to 1."""
    filled = new
    for name, value in (("flags", 0), ("epoch", 1)):
        if name not in new.columns:
            filled = filled.withColumn(name, F.lit(value).cast("long"))
    return rows.unionByName(filled, allowMissingColumns=True)


def bump_epoch(rows: DataFrame, subject: int) -> DataFrame:
    """Raise the epoch of a subject's committed records by one, wrapping at 2^32."""
    hit = (F.col("subject_id") == subject) & (F.col("status") == LIVE)
    return rows.withColumn("epoch", F.when(hit, (F.col("epoch") + 1) % F.lit(WRAP)).otherwise(F.col("epoch")))


def delete_subject(rows: DataFrame, subject: int) -> DataFrame:
    """Mark a subject's committed records as deleted."""
    hit = (F.col("subject_id") == subject) & (F.col("status") == LIVE)
    return rows.withColumn("status", F.when(hit, "tombstone").otherwise(F.col("status")))


def leading_valid(rows: DataFrame, order: str, valid: str) -> DataFrame:
    """How many rows stand before the first invalid one (all, if none is): two aggregates, no sort."""
    first_bad = rows.agg(F.min(F.when(~F.col(valid), F.col(order))).alias("first_bad"))
    bound = first_bad.first()[0]
    return rows.agg((F.count(F.lit(1)) if bound is None else F.count_if(F.col(order) < bound)).alias("n"))


def synthetic(spark: SparkSession, spokes: int = 100, entities: int = 1000, versions: int = 10) -> DataFrame:
    """Benchmark records: id, opcode, subject_id, predicate_id, target_id, flags, epoch."""
    per = entities * versions
    version, spoke, entity = F.col("id") % versions, F.floor(F.col("id") / per), F.floor(F.col("id") % per / versions)
    return spark.range(spokes * per).select(
        "id",
        (version + 0x1000).alias("opcode"),
        F.format_string("s_%04d_%06d", spoke, entity).alias("subject_id"),
        F.lit("has_version").alias("predicate_id"),
        F.lit("target").alias("target_id"),
        F.when(version % 2 == 1, 1).otherwise(2).cast("long").alias("flags"),
        version.alias("epoch"),
    )


def header_rows(spark: SparkSession, n: int) -> DataFrame:
    """Three tagged thirds (40, 30 and 30 per cent) of opcode 1001 with provenance (tag << 32) + i."""
    i = F.col("id")
    tag = F.when(i < n * 4 // 10, 1).when(i < n * 7 // 10, 2).otherwise(3).cast("long")
    return spark.range(n).select(i, F.lit(1001).cast("long").alias("opcode"), tag.alias("tag"), (F.shiftleft(tag, 32) + i).alias("provenance"))


def spoke_of(subject: str, spokes: int = 100):
    """Partition of ``s_<number>_...``; any other name goes by its 32-bit FNV-1a hash."""
    from trove.functions.hashing import fnv1a32

    number = F.regexp_extract(F.col(subject), r"^s_(\d{4})_", 1)
    return F.when(number != "", number.cast("long") % spokes).otherwise(fnv1a32(F.col(subject)) % spokes)
