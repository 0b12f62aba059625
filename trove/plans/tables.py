"""Readers for the input tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs up to this many bytes are spread over all cores; larger ones have splits enough.
SMALL_BYTES = 24 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt evenly to all cores, since one file of one row group is one task; a large one as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df
