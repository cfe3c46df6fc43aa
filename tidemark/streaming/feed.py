"""The change feed, over a whole log or as it grows, and the latest values kept by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.shared import bounded, materialize


def with_source(log: DataFrame, batches: DataFrame | None = None, transactions: DataFrame | None = None) -> DataFrame:
    """The log with a column source: batch or transaction for the commits (commit_ts) that are named as such, put for others."""
    out = log.withColumn("source", F.lit("put"))
    for name, commits in (("batch", batches), ("transaction", transactions)):
        if commits is not None:
            named = bounded(materialize(commits.select("commit_ts").distinct(), "commits")).withColumn("_named", F.lit(name))
            out = out.join(named, "commit_ts", "left").withColumn("source", F.coalesce("_named", "source")).drop("_named")
    return out


def changes(log: DataFrame) -> DataFrame:
    """An event for each op: key_updated with its value (left out if empty), or key_deleted. Works on streams too.

    Where the log has a column source (put, batch or transaction), so have the
    events: subscribers who want single puts and deletes only can tell them.
    """
    more = ["source"] if "source" in log.columns else []
    return log.select(
        F.when(F.col("op") == "PUT", "key_updated").otherwise("key_deleted").alias("event"),
        "cf",
        "key",
        F.when(F.col("op") == "PUT", F.nullif("value", F.lit(""))).alias("value"),
        "commit_ts",
        *more,
    )


def as_json(events: DataFrame) -> DataFrame:
    """Events as JSON lines; absent values leave no field."""
    return events.select(F.to_json(F.struct("event", "key", "value", "cf")).alias("line"))


def latest_view(log_stream: DataFrame) -> DataFrame:
    """The newest version of each key seen so far, tombstones too so that late older puts can't revive a key: one row of state a key, any order of arrival."""
    put = (F.col("op") == "PUT") & (F.octet_length("value") > 0)
    version = F.struct(F.when(put, F.col("value")).alias("value"), "commit_ts")
    return log_stream.groupBy("cf", "key").agg(F.max_by(version, F.struct("commit_ts", "seq")).alias("v")).select("cf", "key", F.col("v.value").alias("value"), F.col("v.commit_ts").alias("commit_ts"))


def subscribe(stream: DataFrame, sinks: list[tuple[str, str]], every: str | None = None) -> list[StreamingQuery]:
    """One running query for each subscriber (folder, checkpoint): each keeps its own place, so a slow or late one holds up no other.

    With `every`, such as "10 seconds", they go on by that trigger until they are stopped; without, they
    process what is there and end. How much a trigger takes at most is the reader's
    maxFilesPerTrigger or maxBytesPerTrigger.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return [stream.writeStream.option("checkpointLocation", at).trigger(**trigger).format("parquet").option("path", path).outputMode("append").start() for path, at in sinks]


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there into a Parquet folder and ends; in complete mode each batch replaces the folder."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return query
