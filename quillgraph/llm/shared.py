"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a join's build side that a task may hold in memory.
BUILD_BYTES = 256 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where that is unset, a session on one machine (master local, as in tests) gets a new
    local folder; on a cluster, whose machines share none, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it has no lineage and outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names that differ in case only can't be written
    plain.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_side(df: DataFrame, size: int) -> DataFrame:
    """df, marked as the build side of a shuffled hash join where `size`, its bytes at most, allows; else Spark sorts, and can spill."""
    return df.hint("shuffle_hash") if size <= BUILD_BYTES * partitions(df.sparkSession) else df
