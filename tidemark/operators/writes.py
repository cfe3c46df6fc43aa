"""Batches and transactions as relations over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.sources.fixtures import LOG


def next_ts(log: DataFrame) -> int:
    """The next commit timestamp; the first of an empty log is 2."""
    return max(2, (log.agg(F.max("commit_ts")).first()[0] or 0) + 1)


def apply_batch(log: DataFrame, batch: DataFrame, commit_ts: int) -> DataFrame:
    """The log with a batch (cf, key, seq, op, value) at one timestamp; of several ops on a key the last counts. Families share the commit."""
    return log.select(LOG).unionByName(batch.withColumn("commit_ts", F.lit(commit_ts).cast("long")).select(LOG))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with a family: the default one if they name none."""
    return rows.withColumn("cf", F.coalesce(F.nullif("cf", F.lit("")), F.lit(versions.DEFAULT)) if "cf" in rows.columns else F.lit(versions.DEFAULT))


def pending(writes: DataFrame) -> DataFrame:
    """The last buffered op of each transaction, family and key."""
    last = _placed(writes).groupBy("txn_id", "cf", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    return last.select("txn_id", "cf", "key", F.col("w.op").alias("pending_op"), F.col("w.value").alias("pending_value"))


def overlay(log: DataFrame, writes: DataFrame, reads: DataFrame) -> DataFrame:
    """What transactions read, (txn_id, start_ts, key and maybe cf): their own pending op, else the snapshot at their start."""
    asked = _placed(reads).withColumn("req_id", F.col("txn_id"))
    seen = versions.as_of(log, asked.select("req_id", "cf", "key", F.col("start_ts").alias("snapshot_ts")))
    mine = seen.select(F.col("req_id").alias("txn_id"), "cf", "key", F.col("value").alias("snapshot_value")).join(pending(writes), ["txn_id", "cf", "key"], "left")
    own = F.when(F.col("pending_op") == "PUT", F.nullif("pending_value", F.lit("")))
    return mine.select(
        "txn_id",
        "cf",
        "key",
        F.when(F.col("pending_op").isNotNull(), own).otherwise(F.col("snapshot_value")).alias("value"),
        F.when(F.col("pending_op").isNotNull(), "pending").when(F.col("snapshot_value").isNotNull(), "snapshot").otherwise("none").alias("source"),
    )


def conflicts(log: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn_id, cf, key) of written keys with a version committed after the transaction's start and before its own place.

    Deletes count; a key of the same name in another family doesn't. The newest version before the commit
    tells it all, so this is an as-of read of the write set, not a join with all later versions.
    """
    asked = _placed(writes).select(F.struct("txn_id", "start_ts").alias("req_id"), "cf", "key", (F.col("txn_id") + 1).alias("snapshot_ts"))
    seen = versions.as_of(log, asked).where(F.col("commit_ts") > F.col("req_id.start_ts"))
    return seen.select(F.col("req_id.txn_id").alias("txn_id"), "cf", "key", "commit_ts").distinct()  # a key may be written twice


def clean(log: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions that may commit."""
    return writes.select("txn_id").distinct().join(conflicts(log, writes).select("txn_id").distinct(), "txn_id", "left_anti")
