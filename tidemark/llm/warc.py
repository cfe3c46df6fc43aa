"""Merkle fixity audit of WARC replicas.

Pages become WARC records (header lines, blank line, body). Records of the same
file lie end to end in order of their id; an index gives each record's place:
its file and its offset there. Each replica is laid out by itself. Records hash
into ranges of `RANGE_BYTES` of a file's offsets, ranges into ranges `FANOUT`
times as wide, up to one root over all files. Two replicas with equal roots are
equal. Else the audit descends: at each level it compares only the children of
nodes that differ, and at last only the records of the ranges that differ. These
are matched by id: a record that grew, shrank, went or came shifts those behind
it in its file, and no more than that file's ranges are looked at; shifted
records that are whole are no damage.

Every group that is hashed is bounded by its range (a record has at least a
header's bytes; equal places don't occur). Null urls and bodies count as empty,
line ends in urls are escaped; rows with a null id come first. Rows of an id that
is repeated are records of their own and matched by content; equal ones have the
same Record-ID. Empty replicas have equal, empty trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, materialize
from tidemark.llm.sharding import prefix_sums

RANGE_BYTES = 1 << 18
FANOUT = 256
#: Ids of one archive file, and the places that it takes (more bytes than any file has).
FILE_IDS = 1000
FILE_SPAN = 1 << 40
#: The date of records whose capture time isn't known; the header is mandatory.
DATE = "1970-01-01T00:00:00Z"


def record(id_col: Column, url: Column, body: Column, stored: Column | None = None, date: Column | None = None) -> Column:
    """A WARC resource record as text. With `stored`, the record of `body` whose body has become another: damage behind a whole header."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    named = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(" "), url, F.lit(" "), body)
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"),
        F.md5(named.cast("binary")),
        F.lit(">\r\nWARC-Date: "),
        F.lit(DATE) if date is None else date,
        F.lit("\r\nWARC-Target-URI: "),
        F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body if stored is None else stored, F.lit("\r\n\r\n"))


def index(records: DataFrame, name: str = "warc") -> DataFrame:
    """From (id, size, digest, ...): each record's file, its offset there, and `at`, the place of both."""
    keys = [c for c in records.columns if c not in ("size",)]
    placed = prefix_sums(records, keys, name).withColumn("file", F.coalesce(F.floor(F.col("id") / FILE_IDS), F.lit(-1)).cast("long"))
    bases = bounded(materialize(placed.groupBy("file").agg(F.min("byte_place").alias("base")), f"{name}-files"))
    return placed.join(bases, "file").select(*records.columns, "file", (F.col("byte_place") - F.col("base")).alias("offset"), (F.col("file") * FILE_SPAN + F.col("byte_place") - F.col("base")).alias("at"))


def _parent(width: int) -> str:
    return f"(at - pmod(at, {width}L)) div {width}L"  # rounded down, also before 0


def _ranges(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes (replica, at, digest) hashed into ranges of the given width: each hash covers the places and hashes of its children."""
    child = F.expr("array_join(transform(array_sort(collect_list(struct(at, digest))), c -> concat(c.at, ':', c.digest)), ',')")
    return nodes.groupBy("replica", F.expr(_parent(width)).alias("node")).agg(F.sha2(child, 256).alias("digest")).select("replica", F.col("node").alias("at"), "digest")


def build(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """From (replica, at, digest): the levels above, each written, up to one root a replica (or one for places before 0 as well)."""
    ends = leaves.agg(F.min("at"), F.max("at")).first()
    levels, width, nodes = [], range_bytes, leaves
    while True:
        nodes = materialize(_ranges(nodes, range_bytes if not levels else fanout), f"level-{len(levels)}")
        levels.append(nodes)
        if ends[1] is None or max(ends[1], -1 - ends[0]) < width:
            return levels
        width *= fanout


def _differ(nodes: DataFrame) -> DataFrame:
    """Places where the two replicas' hashes aren't both there and equal."""
    return nodes.groupBy("at").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("n <> 2 or x <> y").select("at")


def suspects(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The leaves of both replicas (replica, at, digest, ...) in ranges that differ, found by descending from the roots."""
    levels = build(leaves, range_bytes, fanout)
    frontier = materialize(_differ(levels[-1]), "frontier")
    for nodes in reversed(levels[:-1]):
        parents = bounded(frontier.select(F.col("at").alias("parent")))
        below = nodes.withColumn("parent", F.expr(_parent(fanout))).join(parents, "parent", "left_semi")
        frontier = materialize(_differ(below.select("replica", "at", "digest")), "frontier")
    parents = bounded(frontier.select(F.col("at").alias("parent")))
    return leaves.withColumn("parent", F.expr(_parent(range_bytes))).join(parents, "parent", "left_semi").drop("parent")


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Damage of the second of two indexed replicas: id, problem, and the place and size of the record, in the first or, if extra, in the second.

    A record of the first that isn't in the second is missing, or changed where
    the second has another of its id instead; one that only the second has is
    extra. `n` is the number of such records of the id.
    """
    side = lambda df, k: df.select(F.lit(k).alias("replica"), "id", "at", "file", "offset", "size", "digest")
    met = suspects(side(first, 0).unionByName(side(second, 1)), range_bytes, fanout)
    place = F.struct("at", "file", "offset", "size")
    same = met.groupBy("id", "digest").agg(
        F.sum(F.when(F.col("replica") == 0, 1).otherwise(-1)).alias("more"),
        F.min(F.when(F.col("replica") == 0, place)).alias("p0"),
        F.min(F.when(F.col("replica") == 1, place)).alias("p1"),
    )
    found = same.where("more <> 0").groupBy("id").agg(
        F.sum(F.greatest("more", F.lit(0))).alias("lost"),
        F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("new"),
        F.min(F.when(F.col("more") > 0, F.col("p0"))).alias("p0"),
        F.min(F.when(F.col("more") < 0, F.col("p1"))).alias("p1"),
    )
    problem = F.when((F.col("lost") > 0) & (F.col("new") > 0), "changed").when(F.col("lost") > 0, "missing").otherwise("extra")
    at = F.coalesce("p0", "p1")
    return found.select("id", at["file"].alias("file"), at["offset"].alias("offset"), at["size"].alias("size"), problem.alias("problem"), F.greatest("lost", "new").alias("n"))
