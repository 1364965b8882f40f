"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, in local mode, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor doesn't undo it."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """df over all cores (by columns, if any), for work that grows far beyond df: a small file is one task, and small partitions are put together."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, least)
    return df.repartition(n, *by)
