"""Intermediate tables in the folder that the whole cluster shares.

Iterative jobs cut their lineage by writing a Parquet table and reading it back.  The table goes below
``spark.checkpoint.dir``, so a lost executor loses nothing: the next stage reads the files again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one of our own only in local mode without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="trove-")
    return _own_dirs[context.applicationId]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/trove-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a scratch table and return a frame that reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to this many key rows are broadcast (some 24 MB of ids); more go through a shuffle.
BROADCAST_ROWS = 500_000


def sized(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a side whose row count was checked against a bound; without it above the bound."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def discard(df: DataFrame) -> None:
    """Delete the files of a scratch table that no later plan reads."""
    spark = df.sparkSession
    jvm, root = spark.sparkContext._jvm, shared_dir(spark)
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/trove-" not in path:
            raise ValueError(f"{path} is not a scratch table below {root}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
