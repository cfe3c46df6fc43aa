"""Point reads and prefix scans. Unlike an absent key, an unknown column family is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.sources.shared import materialize

DEFAULT = versions.DEFAULT
SYSTEM = ("__auth__", "__meta__", "__keyspace__")


def family(cf: str) -> str:
    """The empty name means the default family."""
    return cf or DEFAULT


def successor(prefix: bytes) -> bytes | None:
    """The least byte string greater than all that begin with the prefix, if there is one."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column, prefix: str | bytes) -> Column:
    """A predicate that reaches the file scan for text and for binary keys."""
    if not prefix:
        return F.lit(True)
    if isinstance(prefix, str):
        return key.startswith(prefix)
    above = successor(prefix)
    low = key >= F.lit(prefix)
    return low if above is None else low & (key < F.lit(above))


def get(log: DataFrame, key, cf: str = DEFAULT, snapshot: int | None = None) -> DataFrame:
    """One row, or none if the key is absent at the snapshot."""
    return versions.latest(log.where((F.col("cf") == family(cf)) & (F.col("key") == F.lit(key))), snapshot).select("key", "value")


def scan(log: DataFrame, prefix: str | bytes = "", cf: str = DEFAULT, snapshot: int | None = None) -> DataFrame:
    """Live keys with a prefix, ascending by bytes."""
    own = log.where((F.col("cf") == family(cf)) & has_prefix(F.col("key"), prefix))
    return versions.latest(own, snapshot).select("key", "value").orderBy("key")


def observed_scan(log: DataFrame, prefix: str = "", cf: str = DEFAULT) -> DataFrame:
    """The scan as the replaced store's code behaves: tombstones skip only themselves and the oldest put wins."""
    own = versions.normalized(log.where((F.col("cf") == family(cf)) & has_prefix(F.col("key"), prefix))).where("op = 'PUT'")
    return own.groupBy("key").agg(F.min_by("value", F.struct("commit_ts", "seq")).alias("value"))


def families(log: DataFrame) -> DataFrame:
    return log.select("cf").distinct()


def stats(log: DataFrame) -> DataFrame:
    """Live keys of each family."""
    return versions.latest(log).groupBy("cf").agg(F.count("*").alias("n_keys"))


def total(rows: DataFrame) -> DataFrame:
    """How many rows a scan has."""
    return rows.agg(F.count("*").alias("total"))


def as_json(rows: DataFrame, prefix: str = "", cf: str = DEFAULT, page: int = 1000) -> DataFrame:
    """A scan's answer over HTTP, {cf, prefix, items: [{key, value}]}, in order of keys, in pages of so many items.

    A scan that fits a page is one line, an empty one too; a larger one is several, numbered, so that no
    task holds all items. Items are numbered over range partitions, whose counts are a small table.
    """
    ranged = materialize(rows.select("key", "value").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "page")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1)
    pages = placed.groupBy(F.expr(f"place div {page}").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "value"))), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("items"))
    none = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("page"))
    answer = F.to_json(F.struct(F.lit(family(cf)).alias("cf"), F.lit(prefix).alias("prefix"), F.coalesce("items", F.array().cast("array<struct<key:string,value:string>>")).alias("items")))
    return pages.join(none, "page", "full").select("page", answer.alias("body"))


def as_tsv(rows: DataFrame) -> DataFrame:
    """Scanned rows as lines: key, tab, value."""
    return rows.select(F.concat_ws("\t", "key", "value").alias("line"))


def export(rows: DataFrame, path: str) -> None:
    """Writes a scan as text files, in order from file to file."""
    as_tsv(rows).write.text(path)
