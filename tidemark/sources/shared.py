"""Durable cuts: tables written to a folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids up to which a side is broadcast after it was counted; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a folder under /tmp for local runs only."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "/tmp/tidemark-shared"
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again.

    The lineage ends there, so a lost executor costs no recomputation; column
    pruning still reaches the copy. It is removed by release(), or when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy._tidemark_path = path
    return copy


def release(*tables: DataFrame) -> None:
    """Removes written tables that no later step reads."""
    for df in tables:
        _remove(df.sparkSession, df._tidemark_path)


def bounded(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (materialized) side has at most `limit` rows; else the side as it is, to be shuffled."""
    return F.broadcast(ids) if ids.count() <= limit else ids
