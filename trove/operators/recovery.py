"""Damage and recovery of stored rows: digests beside payloads, seeded faults, and a position-aware scan per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of damage a seeded fault makes; the last leaves the row whole.
FAULTS = ["flip_first", "flip_last", "cut_tail", "cut_all", "append", "zero", "swap_digest", "none"]
MODES = ("permissive", "dropcorrupt", "failfast")


def stored(rows: DataFrame, payload: Column) -> DataFrame:
    """Add the payload as bytes and its digest."""
    return rows.withColumn("payload", F.encode(payload, "UTF-8")).withColumn("digest", F.sha2("payload", 256))


def fault_of(position: Column, seed: int, kinds: int = len(FAULTS)) -> Column:
    """The kind of fault that a seed gives a position."""
    return F.element_at(F.array(*[F.lit(k) for k in FAULTS]), (F.pmod(position * 31 + seed, F.lit(kinds)) + 1).cast("int"))


def with_fault(rows: DataFrame, kind: Column) -> DataFrame:
    """Rows of ``stored`` with the damage of a kind done to payload or digest; payloads are not empty."""
    p, n = F.col("payload"), F.octet_length("payload")
    flipped = lambda one: F.unhex(F.lpad(F.hex(F.conv(F.hex(one), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0"))
    payload = (
        F.when(kind == "flip_first", F.concat(flipped(F.substring(p, F.lit(1), F.lit(1))), F.substring(p, F.lit(2), n)))
        .when(kind == "flip_last", F.concat(F.substring(p, F.lit(1), n - 1), flipped(F.substring(p, n, F.lit(1)))))
        .when(kind == "cut_tail", F.substring(p, F.lit(1), n - 1))
        .when(kind == "cut_all", F.unhex(F.lit("")))
        .when(kind == "append", F.concat(p, F.unhex(F.lit("00"))))
        .when(kind == "zero", F.unhex(F.repeat(F.lit("00"), n)))
        .otherwise(p)
    )
    digest = F.when(kind == "swap_digest", F.reverse("digest")).otherwise(F.col("digest"))
    return rows.withColumn("digest", digest).withColumn("payload", payload)


def sound(payload: str = "payload", digest: str = "digest") -> Column:
    """Whether the stored digest is that of the payload."""
    return F.coalesce(F.sha2(payload, 256) == F.col(digest), F.lit(False))


def read_mode(rows: DataFrame, mode: str = "permissive") -> DataFrame:
    """Rows with a column ``corrupt``; those that fail their digest stay marked, go, or fail the job."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    marked = rows.withColumn("corrupt", ~sound())
    if mode == "dropcorrupt":
        return marked.where("NOT corrupt")
    return marked if mode == "permissive" else marked.withColumn("corrupt", F.when(F.col("corrupt"), F.raise_error(F.lit("a stored row fails its digest"))).otherwise(F.lit(False)))


def recover(rows: DataFrame, segment: str, slot: str, watermark: int) -> DataFrame:
    """Add health: healthy, corrupt (a bad row below the watermark), or torn (the first bad row from it on); what follows is cut off.

    Each segment recovers by itself: one aggregate finds where it tears, and a join leaves out what lies behind.
    """
    marked = rows.withColumn("_sound", sound())
    torn = marked.where(~F.col("_sound") & (F.col(slot) >= watermark)).groupBy(segment).agg(F.min(slot).alias("_torn"))
    kept = marked.join(torn, segment, "left").where(F.col("_torn").isNull() | (F.col(slot) <= F.col("_torn")))
    health = F.when(F.col("_sound"), "healthy").when(F.col(slot) < watermark, "corrupt").otherwise("torn")
    return kept.withColumn("health", health).drop("_sound", "_torn")
