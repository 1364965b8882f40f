"""Intermediate tables in the shared folder of the cluster, and input loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_LOGS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests in local mode), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later jobs read it, and a lost executor doesn't undo it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for log in _LOGS:
        log.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, key: str, reader: SparkSession) -> DataFrame:
    """df as a table in the shared folder, in buckets by the key, as ``reader`` sees it: what works by the key needs no shuffle."""
    name = f"quern_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    for log in _LOGS:
        log.append(path)
    out = reader.table(name)
    _PATHS[out] = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that ``written`` made and that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and that no result depends on."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            delete(t.sparkSession, [path])


@contextmanager
def logged(log: list[str]) -> Iterator[None]:
    """Adds the folders of all tables that are written meanwhile to the log."""
    _LOGS.append(log)
    try:
        yield
    finally:
        _LOGS.remove(log)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default of 10,000, so that long texts fit in a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
