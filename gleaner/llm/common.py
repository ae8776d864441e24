"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one process alone gets a temporary one; a cluster raises."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to a folder and read back: cut() for large tables, as compressed columns that remove() can drop early.

    Spark deletes the shuffles behind the write when the driver collects garbage, which may be long after; so it does now.
    """
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, in whatever store they are, that no later result reads."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column over all rows (0 for an empty table)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def blocks_for(spark: SparkSession, n_bytes: int, block_bytes: int) -> int:
    """Blocks of about block_bytes each, and never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // block_bytes))


def crc_mod(column: str, modulus: int):
    """crc32 of a column's text form, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def give_back() -> None:
    """Return what a worker has freed to the system; idle workers would hold it until their next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return
