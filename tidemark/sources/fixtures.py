"""Versioned key-value logs derived from the driver's tables.

A version log has the columns cf, key, commit_ts, seq, op (PUT or DELETE) and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = ["cf", "key", "commit_ts", "seq", "op", "value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User properties over time: errors delete, every 101st put is empty."""
    return table(spark, sf_dir, "events").select(
        F.lit("default").alias("cf"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        (F.col("event_id") + 2).alias("commit_ts"),
        F.lit(0).alias("seq"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.expr("case when event_type = 'error' then null when event_id % 101 = 0 then '' else props end").alias("value"),
    )


def kv_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("cf"),
        F.expr("concat('cust:', lpad(cast(o_custkey as string), 7, '0'), ':order:', lpad(cast(o_orderkey as string), 9, '0'))").alias("key"),
        (F.col("o_orderkey") + 2).alias("commit_ts"),
        F.lit(0).alias("seq"),
        F.lit("PUT").alias("op"),
        F.concat("o_orderstatus", F.lit("|"), "o_orderpriority").alias("value"),
    )


def kv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.lit("docs").alias("cf"),
        F.expr("concat('doc:', lang, ':', lpad(cast(doc_id as string), 9, '0'))").alias("key"),
        (F.col("doc_id") + 2).alias("commit_ts"),
        F.lit(0).alias("seq"),
        F.lit("PUT").alias("op"),
        F.col("text").alias("value"),
    )


def kv_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_events(spark, sf_dir).unionByName(kv_orders(spark, sf_dir)).unionByName(kv_docs(spark, sf_dir))


def kv_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that have keys of the same names: the events' and a mirror of them at other times, and orders."""
    own = kv_events(spark, sf_dir)
    mirror = own.select(F.lit("mirror").alias("cf"), "key", (F.col("commit_ts") * 2 - 1).alias("commit_ts"), "seq", "op", F.concat(F.lit("m"), "value").alias("value"))
    return own.unionByName(mirror).unionByName(kv_orders(spark, sf_dir))


def in_family(rows: DataFrame, number: str) -> DataFrame:
    """Requests or writes spread over families; every third names none, which means the default one."""
    n = F.col(number)
    return rows.withColumn("cf", F.when(n % 3 == 0, F.lit(None).cast("string")).when(n % 2 == 0, "mirror").otherwise("default"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' log as four overlapping sorted runs."""
    return kv_events(spark, sf_dir).withColumn("run", F.col("commit_ts") % 4)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id % 50 = 0").select(
        F.col("event_id").alias("req_id"), F.expr("concat('user:', cast((user_id * 7) % 200 as string))").alias("key"), F.col("event_id").alias("snapshot_ts")
    )


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of puts and deletes, many to the same keys; it has no commit_ts yet."""
    return table(spark, sf_dir, "events").where("event_id % 10 = 3").select(
        F.lit("default").alias("cf"),
        F.expr("concat('user:', cast(user_id as string))").alias("key"),
        F.col("event_id").cast("int").alias("seq"),
        F.expr("case when event_id % 20 = 3 then 'PUT' else 'DELETE' end").alias("op"),
        F.expr("case when event_id % 20 = 3 then concat('batch-', cast(event_id as string)) end").alias("value"),
    )


def cf_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).withColumn("cf", F.when(F.col("seq") % 3 == 0, "orders").otherwise("default"))


def txn_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pending writes of each transaction: (txn_id, start_ts, key, seq, op, value)."""
    txns = table(spark, sf_dir, "events").where("event_id % 97 = 0").select(F.col("event_id").alias("txn_id"), (F.col("event_id") + 2 - 40).alias("start_ts"), "user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return txns.select(
        "txn_id",
        "start_ts",
        F.expr("concat('user:', cast(user_id + seq as string))").alias("key"),
        "seq",
        F.expr("case when seq = 1 and txn_id % 2 = 0 then 'DELETE' else 'PUT' end").alias("op"),
        F.expr("case when seq = 1 and txn_id % 2 = 0 then null else concat('txn-', cast(txn_id as string)) end").alias("value"),
    )


def txn_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction reads both keys that it wrote, and one more."""
    txns = table(spark, sf_dir, "events").where("event_id % 97 = 0")
    return txns.select(F.col("event_id").alias("txn_id"), (F.col("event_id") + 2 - 40).alias("start_ts"), F.explode(F.expr("transform(sequence(0, 2), i -> concat('user:', cast(user_id + i as string)))")).alias("key"))


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records (ts, ops): single ops, and batches of ten consecutive events."""
    ops = kv_events(spark, sf_dir).withColumn("event_id", F.col("commit_ts") - 2).withColumn("block", F.floor(F.col("event_id") / 10))
    grouped = F.when(F.col("block") % 3 == 0, -1 - F.col("block")).otherwise(F.col("event_id"))
    one = F.struct("event_id", "op", "key", "value")
    return ops.groupBy(grouped.alias("record")).agg(F.max("commit_ts").alias("ts"), F.array_sort(F.collect_list(one)).alias("ops"))  # ten at most


def manifest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = "named_struct('file_num', {0}, 'level', cast({0} % 3 as int), 'min_key', lpad(cast(o_custkey as string), 7, '0'), 'max_key', lpad(cast(o_custkey + 100 as string), 7, '0'), 'size', cast(floor(o_totalprice) as bigint))"
    gone = "if(o_orderkey % 5 = 0, array(named_struct('file_num', o_orderkey - 3, 'level', cast((o_orderkey) % 3 as int))), array())"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edit_seq"), F.expr(f"array({file.format('o_orderkey')})").alias("new_files"), F.expr(gone).alias("deleted_files"), (F.col("o_orderkey") + 1).alias("next_file_num")
    )


def big_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose values are too large to stay inline: (doc_id, size)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size")).where("size > 64")


def auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User records as JSON values under user: keys; every 50th is malformed."""
    roles = "case c_mktsegment when 'AUTOMOBILE' then '[\"admin\"]' when 'BUILDING' then '[\"readwrite\"]' when 'FURNITURE' then '[\"readonly\"]' when 'HOUSEHOLD' then '[\"readwrite\",\"readonly\"]' else '[]' end"
    name = "lower(trim(c_name))"
    value = f"if(c_custkey % 50 = 49, '{{bad', concat('{{\"username\":\"', {name}, '\",\"roles\":', {roles}, ',\"created_at\":', cast(c_custkey + 1700000000 as string), '}}'))"
    return table(spark, sf_dir, "customer").select(
        F.lit("__auth__").alias("cf"), F.expr(f"concat('user:', {name})").alias("key"), (F.col("c_custkey") + 2).alias("commit_ts"), F.lit(0).alias("seq"), F.lit("PUT").alias("op"), F.expr(value).alias("value")
    )
