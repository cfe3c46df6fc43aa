"""Contiguous shards of near-equal bytes from global prefix sums.

Rows of (id, size, checksum), never texts, are range-partitioned by id. Each
partition keeps running sums of its bytes and rows; the partitions' totals are
few, so their prefix sums are one small table that is broadcast. A row's place
in bytes, at its middle, times the number of shards over the total gives its
shard, so every cut is within one row of its target.

Null and empty texts weigh 8 bytes; their checksum is 0. Null ids come first.
Equal ids and repeated rows are ordered by checksum and size and may be split
over partitions (rows equal in all three are interchangeable), so no hot id
lands in one task. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize, ship

ship(__name__)

ROW_OVERHEAD = 8
N_SHARDS = 24


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, bytes_, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(1).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size) + bytes_
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.full(n, part, np.int32)), pa.array(upto - size), pa.array(np.arange(rows, rows + n, dtype=np.int64))],
            names=[*batch.schema.names[:-1], "part", "bytes_before", "rows_before"],
        )
        bytes_, rows = int(upto[-1]), rows + n


def prefix_sums(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows (id, size, others) in order of `keys`, each with its byte_place and row_place, and the total of bytes.

    Rows equal in all keys may be cut apart between partitions; the places are
    fixed by a written table, so a retry cannot move them.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("part", T.IntegerType()), T.StructField("bytes_before", T.LongType()), T.StructField("rows_before", T.LongType())])
    placed = materialize(rows.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").mapInArrow(_running, schema), name)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row a partition
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    return placed.join(F.broadcast(offsets), "part").select(
        *rows.columns[:-1], (F.col("byte_offset") + F.col("bytes_before")).alias("byte_place"), (F.col("row_offset") + F.col("rows_before")).alias("row_place"), "total"
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, size, text_crc32, shard and slot (its place in the shard, from 0)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    cut = prefix_sums(rows, ["id", "text_crc32", "size"], "shards").select(
        "id",
        "size",
        "text_crc32",
        F.expr(f"cast(least({n_shards - 1}, ((2 * byte_place + size) * {n_shards}) div (2 * total)) as int)").alias("shard"),
        F.col("row_place").alias("place"),
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # at most n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
