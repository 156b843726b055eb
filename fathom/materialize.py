"""Cutting lineage: a DataFrame written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fathom.constants import BROADCAST_ROWS
from fathom.errors import require

#: Bytes of a row group: what a task's writer holds in memory.
ROW_GROUP = 32 << 20
WRITTEN = {"parquet.block.size": ROW_GROUP, "mapreduce.fileoutputcommitter.marksuccessfuljobs": False}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, set only where the session has none on a local master; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        require(master.startswith("local[") or master == "local", "no_shared_dir", "set spark.checkpoint.dir to a folder all executors share")
        found = "/tmp/fathom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; survives lost executors. What is written goes when the session's
    JVM ends, or earlier by ``discard``. No success marker is written: nothing reads it, and by its
    code Hadoop's local file system starts a `chmod` for each file that the driver creates."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{uuid.uuid4().hex}"
    df.write.options(**WRITTEN).parquet(path)
    at, files = _located(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    at, files = _located(df.sparkSession, df.stored_path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS):
    """A broadcast hint for a stored table of few narrow rows; none beyond, where the join shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df
