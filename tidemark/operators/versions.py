"""Version selection over a log: the newest visible version of each key, histories, as-of reads.

Rules: a version is visible at a snapshot if its commit_ts is not later; the
newest visible one decides; a DELETE, or a PUT of an empty or null value, means
the key is absent. Tombstones are dropped only after the newest was chosen.
Equal commit_ts are decided by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import BROADCAST_ROWS

VERSION = ["op", "value", "commit_ts", "seq"]
#: The family of keys that name none.
DEFAULT = "default"
#: Timestamps of one slice: the most versions of a key, but for ties, that one task sorts.
SLICE = 1 << 20


def normalized(log: DataFrame) -> DataFrame:
    """An empty or null PUT is a DELETE; a DELETE has no value."""
    put = (F.col("op") == "PUT") & (F.octet_length("value") > 0)
    return log.withColumn("op", F.when(put, "PUT").otherwise("DELETE")).withColumn("value", F.when(put, F.col("value")))


def at(log: DataFrame, snapshot: int | None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("commit_ts") <= snapshot)


def newest(log: DataFrame, by: tuple[str, ...] = ("cf", "key")) -> DataFrame:
    """The newest version of each key, tombstones too: the rank limit prunes before the shuffle, so a hot key sends one row a task."""
    order = Window.partitionBy(*by).orderBy(F.desc("commit_ts"), F.desc("seq"))
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Live keys at a snapshot (None: now): cf, key, value, commit_ts."""
    return newest(normalized(at(log, snapshot))).where("op = 'PUT'").select("cf", "key", "value", "commit_ts")


def latest_info(log: DataFrame) -> DataFrame:
    """Of every key ever written: the value, null if absent, and the last commit_ts."""
    return newest(normalized(log)).select("cf", "key", "value", "commit_ts")


def last_commit(log: DataFrame) -> DataFrame:
    return log.groupBy("cf", "key").agg(F.max("commit_ts").alias("last_commit_ts"))


def history(log: DataFrame) -> DataFrame:
    """All versions of all keys, newest first."""
    return log.select("cf", "key", "commit_ts", "seq", "op", "value").orderBy("cf", "key", F.desc("commit_ts"), F.desc("seq"))


def _slice(ts: str, width: int) -> Column:
    """The stretch of time that a timestamp falls into; keys with very many versions are worked on stretch by stretch."""
    return F.floor(F.col(ts) / width).alias("slice")


def intervals(log: DataFrame, width: int = SLICE) -> DataFrame:
    """Each live version's half-open interval of validity; valid_to is null for the current one.

    A version's successor is looked for in its own slice of time; the last of a
    slice takes the first of the key's next slice from a table of slices.
    """
    own = normalized(log).withColumn("slice", _slice("commit_ts", width))
    order = Window.partitionBy("cf", "key", "slice").orderBy("commit_ts", "seq")
    spans = own.withColumn("near", F.lead("commit_ts").over(order))
    heads = own.groupBy("cf", "key", "slice").agg(F.min("commit_ts").alias("head"))
    heads = heads.withColumn("far", F.lead("head").over(Window.partitionBy("cf", "key").orderBy("slice"))).where("far is not null")
    found = spans.where("op = 'PUT'").join(heads.select("cf", "key", "slice", "far"), ["cf", "key", "slice"], "left")
    return found.select("cf", "key", "value", F.col("commit_ts").alias("valid_from"), F.coalesce("near", "far").alias("valid_to"))


def as_of(log: DataFrame, requests: DataFrame, n_requests: int | None = None, width: int = SLICE) -> DataFrame:
    """For each request (req_id, key, snapshot_ts) the newest version not later, op and commit_ts null if there is none.

    Each family is a keyspace of its own: requests name theirs in a column cf,
    the default one if they have no such column or it is null or empty. Requests
    are merged with the log, slice of time by slice of time, and take the last
    version before them in their slice, or at the end of an earlier one: one row
    a request and version, never their product. The keys of few requests
    (counted) are broadcast first, so that other keys aren't moved. Every
    request is answered, also one with a null req_id.
    """
    cf = F.coalesce(F.nullif("cf", F.lit("")), F.lit(DEFAULT)) if "cf" in requests.columns else F.lit(DEFAULT)
    requests = requests.withColumn("cf", cf)
    place = ["cf", "key"]
    bounds = requests.agg(F.count("*").alias("n"), F.max("snapshot_ts").alias("last")).first()
    own = normalized(log).select(*place, *VERSION)
    if bounds.last is not None:
        own = own.where(F.col("commit_ts") <= bounds.last)
    if (bounds.n if n_requests is None else n_requests) <= BROADCAST_ROWS:
        own = own.join(F.broadcast(requests.select(place).distinct()), place, "left_semi")
    versions_ = own.select(*place, "commit_ts", "seq", F.struct("op", "value", "commit_ts").alias("v"), _slice("commit_ts", width), F.lit(False).alias("asks"))
    marks = requests.select(*place, "req_id", "snapshot_ts", F.col("snapshot_ts").alias("commit_ts"), _slice("snapshot_ts", width), F.lit(True).alias("asks"))
    order = Window.partitionBy(*place, "slice").orderBy("commit_ts", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0)
    near = versions_.unionByName(marks, allowMissingColumns=True).withColumn("near", F.last("v", ignorenulls=True).over(order)).where("asks")
    if bounds.last is not None and bounds.last < width:  # timestamps are positive: there is no earlier slice
        found = near.withColumn("v", F.col("near"))
    else:
        at_ = [*place, "slice"]
        ends = versions_.groupBy(at_).agg(F.max_by("v", F.struct("commit_ts", "seq")).alias("end")).unionByName(marks.select(at_).distinct(), allowMissingColumns=True)
        ends = ends.groupBy(at_).agg(F.max("end").alias("end"))  # one at most isn't null
        before = Window.partitionBy(place).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        far = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).where("far is not null").select(*at_, "far")
        found = near.join(far, at_, "left").withColumn("v", F.coalesce("near", "far"))
    return found.select("req_id", *place, "snapshot_ts", F.col("v.op").alias("op"), F.col("v.value").alias("value"), F.col("v.commit_ts").alias("commit_ts"))


def ranks(log: DataFrame) -> DataFrame:
    """Every version with its rank in its key: 0 is the newest."""
    order = Window.partitionBy("cf", "key").orderBy(F.desc("commit_ts"), F.desc("seq"))
    return log.select("cf", "key", "commit_ts", "seq", "op", (F.row_number().over(order) - 1).alias("rank"))


def in_order(log: DataFrame) -> DataFrame:
    """Versions as runs and compaction lay them down: by family and key, newest first, range by range, without one total sort."""
    return log.repartitionByRange("cf", "key").sortWithinPartitions("cf", "key", F.desc("commit_ts"), F.desc("seq"))


def recent(log: DataFrame, n: int = 100) -> DataFrame:
    """The last n operations, latest first."""
    return log.select("cf", "key", "commit_ts", "seq", "op").orderBy(F.desc("commit_ts"), F.desc("seq"), "cf", "key").limit(n)
