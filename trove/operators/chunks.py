"""Splitting and reassembly of oversized payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a whole payload, and of a linked part beside its 24-byte footer; parts of a chain at most.
WHOLE, LINKED, MOST = 960, 936, 5


def parts_of(size):
    """Parts that a payload of so many bytes needs."""
    return F.when(size <= WHOLE, 1).otherwise(F.ceil(size / F.lit(LINKED))).cast("long")


def split_payloads(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, seq, parts, total, part_key, next_key, part); payloads that need more than ``MOST`` parts are left out.

    ``refused`` lists those.  Part keys are the row's key and the part's number.
    """
    data = F.col(payload).cast("binary")
    sized = rows.select(F.col(key).alias("key"), data.alias("data"), F.octet_length(data).cast("long").alias("total")).withColumn("parts", parts_of(F.col("total")))
    width = F.when(F.col("parts") == 1, WHOLE).otherwise(LINKED)
    out = sized.where(F.col("parts") <= MOST).withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    name = lambda n: F.concat_ws(":", F.col("key").cast("string"), n.cast("string"))
    return out.select(
        "key", "seq", "parts", "total", name(F.col("seq")).alias("part_key"),
        F.when(F.col("seq") + 1 < F.col("parts"), name(F.col("seq") + 1)).alias("next_key"),
        F.substring("data", (F.col("seq") * width + 1).cast("int"), width).alias("part"),
    )


def refused(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, total, parts) of payloads too long for a chain."""
    size = F.octet_length(F.col(payload).cast("binary")).cast("long")
    return rows.select(F.col(key).alias("key"), size.alias("total"), parts_of(size).alias("parts")).where(F.col("parts") > MOST)


def join_payloads(parts: DataFrame) -> DataFrame:
    """(key, data, fault): chains put together again; fault names the first breach, data is null then.

    A chain holds at most five parts, so its list is bounded.
    """
    chain = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "part_key", "next_key", "part"))).alias("c"), F.max("parts").alias("parts"), F.max("total").alias("total"))
    whole = F.unhex(F.array_join(F.transform("c", lambda p: F.hex(p["part"])), ""))
    linked = F.forall(F.transform("c", lambda p, i: p["next_key"].eqNullSafe(F.get("c", i + 1)["part_key"])), lambda x: x)
    counted = F.transform("c", lambda p: p["seq"]) == F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    fault = F.when(F.size("c") != F.col("parts"), "parts").when(~counted, "sequence").when(~linked, "next_key").when(F.octet_length(whole) != F.col("total"), "length")
    return chain.select("key", F.when(fault.isNull(), whole).alias("data"), fault.alias("fault"))
