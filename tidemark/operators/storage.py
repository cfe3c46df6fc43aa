"""Runs, compaction, log replay, manifests and value logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.sources.shared import materialize

VERSION_KEY = ["cf", "key", "commit_ts", "seq"]
INLINE_BYTES = 64
HEADER_BYTES = 8
FRAME_BYTES = 8


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs merged to the live keys: a union and the newest of each key."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return versions.latest(merged)


def run_ranges(runs: DataFrame) -> DataFrame:
    """Versions, least and greatest key of each run."""
    return runs.groupBy("run").agg(F.count("*").alias("n_versions"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def min_snapshot(log: DataFrame) -> int:
    """Half of the last timestamp, as the oldest open snapshot."""
    return (log.agg(F.max("commit_ts")).first()[0] or 0) // 2


def oldest_snapshot(open_snapshots: DataFrame) -> DataFrame:
    """The least start_ts of the open snapshots, 0 if there are none."""
    return open_snapshots.agg(F.coalesce(F.min("start_ts"), F.lit(0)).alias("oldest"))


def compact_documented(log: DataFrame, oldest: int) -> DataFrame:
    """The written rule: the newest version unless deleted; older puts only if not after the oldest snapshot.

    A version that a newer open snapshot needs may go: see compact_safe.
    """
    own = versions.normalized(log)
    first = versions.newest(own)
    if not oldest:
        return first.where("op = 'PUT'")
    older = own.where((F.col("commit_ts") <= oldest) & (F.col("op") == "PUT")).join(first.select(VERSION_KEY), VERSION_KEY, "left_anti")
    return first.where("op = 'PUT'").unionByName(older)


def compact_safe(log: DataFrame, oldest: int) -> DataFrame:
    """All versions after the oldest snapshot, and of those up to it the newest unless deleted: every later read is unchanged."""
    own = versions.normalized(log)
    below = versions.newest(own.where(F.col("commit_ts") <= oldest)).where("op = 'PUT'")
    return own.where(F.col("commit_ts") > oldest).unionByName(below)


def replay(records: DataFrame, cf: str = "default") -> DataFrame:
    """The log of write-ahead records (ts, ops): ops of a batch follow each other at one timestamp."""
    ops = records.select("ts", F.posexplode("ops").alias("seq", "o"))
    return ops.select(F.lit(cf).alias("cf"), F.col("o.key").alias("key"), F.col("ts").alias("commit_ts"), "seq", F.col("o.op").alias("op"), F.col("o.value").alias("value"))


def manifest_files(edits: DataFrame) -> DataFrame:
    """Files that are live after all edits: the last action on each (level, file_num); in one edit deletes come first."""
    added = edits.select("edit_seq", F.explode("new_files").alias("f")).select("edit_seq", F.lit(1).alias("step"), "f.file_num", "f.level", "f.min_key", "f.max_key", "f.size")
    gone = edits.select("edit_seq", F.explode("deleted_files").alias("f")).select("edit_seq", F.lit(0).alias("step"), "f.file_num", "f.level")
    actions = added.unionByName(gone, allowMissingColumns=True)
    last = actions.groupBy("level", "file_num").agg(F.max_by(F.struct("step", "min_key", "max_key", "size"), F.struct("edit_seq", "step")).alias("a"))
    return last.where("a.step = 1").select("level", "file_num", "a.min_key", "a.max_key", "a.size")


def inspect_levels(files: DataFrame) -> DataFrame:
    """Files and bytes of each level, and in all."""
    totals = files.rollup("level").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return totals.select(F.coalesce(F.col("level").cast("string"), F.lit("total")).alias("level"), "n_files", "n_bytes")


def in_level_order(files: DataFrame) -> DataFrame:
    """Files level by level, each level by least key, as a lookup goes through them."""
    return files.orderBy("level", "min_key", "file_num")


def level_places(files: DataFrame) -> DataFrame:
    """Each file's place in its level in that order, from 0."""
    order = Window.partitionBy("level").orderBy("min_key", "file_num")
    return files.select("level", "file_num", (F.row_number().over(order) - 1).alias("place"))


def may_hold(files: DataFrame, key: str) -> DataFrame:
    """Files whose key range holds a key."""
    return files.where((F.col("min_key") <= key) & (F.col("max_key") >= key))


def frame_checksum(value: Column) -> Column:
    """The CRC-32 that guards a value in the value log, unsigned."""
    return F.crc32(value.cast("binary"))


def placement(value: Column) -> Column:
    """Where a value is kept: inline, or beyond 64 bytes in the value log."""
    return F.when(F.octet_length(value) > INLINE_BYTES, "pointer").otherwise("inline")


def laid_out(values: DataFrame, order: str) -> DataFrame:
    """Values (order, size) with their offsets in a value log: header, then frame and value one after another.

    Range partitions keep running sums; their totals, a row each, are summed
    apart and broadcast, so no task sees all rows.
    """
    ranged = values.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "layout")
    frame = F.col("size") + FRAME_BYTES
    totals = ranged.groupBy("_part").agg(F.sum(frame).alias("total"))
    before = totals.select("_part", F.coalesce(F.sum("total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    running = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum(frame).over(running), F.lit(0)))
    return placed.join(F.broadcast(before), "_part").withColumn("offset", F.lit(HEADER_BYTES) + F.col("base") + F.col("before")).drop("_part", "base", "before")


def vlog_live(vlog: DataFrame, live: DataFrame) -> DataFrame:
    """Values that a live pointer (offset, size) names."""
    return vlog.join(live.select("offset", "size").distinct(), ["offset", "size"], "left_semi")


def vlog_garbage(vlog: DataFrame, live: DataFrame) -> DataFrame:
    return vlog.join(live.select("offset", "size").distinct(), ["offset", "size"], "left_anti")


def vlog_relocate(vlog: DataFrame, live: DataFrame) -> DataFrame:
    """Old and new offsets of the live values when the log is rewritten without garbage."""
    kept = vlog_live(vlog, live).withColumnRenamed("offset", "old_offset")
    return laid_out(kept, "old_offset").withColumnRenamed("offset", "new_offset")


def vlog_deref(pointers: DataFrame, vlog: DataFrame) -> DataFrame:
    """Pointers with the value they name, null where offset and size match no value."""
    return pointers.join(vlog, ["offset", "size"], "left")
