"""Structured Streaming forms: drain to a projection, windowed counts, leases held in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trove.plans.scratch import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", per_batch).parquet(sf_dir)


def run_to_table(stream: DataFrame, mode: str, tag: str, fold=None) -> DataFrame:
    """Run a stream over what is there now and return the sink as a frame.

    Each micro-batch writes its own folder, named by its number, so a batch that is tried again replaces itself.
    ``complete`` results keep the last batch only; ``fold`` turns all batches into the final rows.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, tag), scratch_path(spark, tag + "-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    flow = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    flow.awaitTermination()
    sink = spark.read.option("basePath", out).parquet(out)
    if mode == "complete":
        last = sink.agg(F.max("batch")).first()[0]
        return sink.where(F.col("batch") == last).drop("batch")
    return fold(sink) if fold else sink.drop("batch")


def drain(log: DataFrame, key: str, seq: str) -> DataFrame:
    """Append every committed step and keep the last one of each key: an upsert by key, safe to repeat."""
    columns = log.columns

    def last(sink: DataFrame) -> DataFrame:
        rest = [c for c in columns if c != key]
        return sink.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")

    return run_to_table(log, "append", "drain", last)


def daily_counts(events: DataFrame) -> DataFrame:
    """(day, event_type, n) by event time, late rows accepted for a day."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    counts = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return run_to_table(counts.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n"), "complete", "daily")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, began, n) by session windows of event time."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    found = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return run_to_table(found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n"), "complete", "sessions")


def lease_decisions(key: str, rows: pd.DataFrame, lease: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Decide claims (at, holder, expires) of one path in order of time: granted, refreshed or refused."""
    out = []
    for at, holder, expires in sorted(zip(rows["at"], rows["holder"], rows["expires"], strict=True)):
        if lease is None or lease[1] <= at:
            verdict, lease = "granted", (holder, int(expires))
        elif lease[0] == holder:
            verdict, lease = "refreshed", (holder, int(expires))
        else:
            verdict = "refused"
        out.append((key, int(at), holder, verdict))
    return out, lease


def lease_stream(claims: DataFrame) -> DataFrame:
    """(path, at, holder, verdict) for a stream of claims (path, at, holder, expires); the running lease of each path is state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lease = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches))
        out, lease = lease_decisions(key[0], rows, lease)
        if lease is not None:
            state.update(lease)
        yield pd.DataFrame(out, columns=["path", "at", "holder", "verdict"])

    decided = claims.groupBy("path").applyInPandasWithState(step, "path string, at long, holder string, verdict string", "holder string, expires long", "append", GroupStateTimeout.NoTimeout)
    return run_to_table(decided, "append", "leases")


def write_progress(rows: DataFrame, path: str) -> None:
    """Progress events as escaped JSON lines."""
    rows.write.mode("append").json(path)
