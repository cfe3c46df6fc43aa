"""Near-duplicate detection: universal hash minima, banding, verified links, components.

1. One pass hashes each text's word shingles to a set and takes, for each of
   `bands * rows` universal hash functions, the least value over the set. The
   result is written once; nothing later depends on that pass again.
2. Equal sets form a class, a node of the graph; its smallest id stands for it.
   Only standing ids go on.
3. The minima of each band make a bucket key. Buckets with two or more nodes
   are kept; each node is paired with the bucket's smallest.
4. Pairs whose signatures agree too seldom are dropped (at five standard
   deviations under the threshold); the rest are confirmed on the full sets.
5. Components of the links by alternating large-star and small-star steps.
6. Nodes of buckets that still hold several components can have links that no
   star has shown. These are found by an exact prefix filter over such nodes:
   shingles are ordered by rarity, the rarest of each set are its prefix, and
   only sets of different components that share a shingle of their prefixes, at
   places and sizes that leave room for enough common ones, are compared. What
   a template gives to all its pages is frequent and so in no prefix, unless
   the pages are near copies. Members of one component need no further pair,
   so a group of thousands of near copies costs about one pair a member, and
   still no link between components is lost. New links are merged.

With 64 bands of 7 rows a pair at similarity 0.8 is missed once in 3 million.

Texts of fewer words than a shingle are one shingle; null, empty and blank texts
have an empty set and link with nothing. Rows with a null id link with nothing
and have a null component; they are kept. Repeated rows of an id count as one
document for links and are each returned. An id with several texts links by
each of them, and joins their components into one; a row of it without words
still links with nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import annotate, bounded, materialize, release, ship, unused
from tidemark.llm.hashing import BLANKS, hash_words, join_texts, mix, separators

ship(__name__)

BANDS, ROWS = 64, 7
#: Shingles that one numpy call hashes, so that the work stays in the processor's cache.
CHUNK = 1 << 14
_SEED = 20240229

FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("buckets", T.ArrayType(T.LongType(), False)),
    T.StructField("signature", T.BinaryType()),
]


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions on 32-bit values."""
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; A-Z are lower-cased."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data, starts = join_texts(raw)
    begin, _, words = hash_words(data, separators(BLANKS))
    first = np.searchsorted(begin, starts)
    with np.errstate(over="ignore"):
        whole = words
        for k in range(1, width):
            whole = whole[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[k:] if len(whole) else whole
        whole = mix(whole)
        out = []
        for i in range(len(texts)):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= width:
                out.append(np.unique(whole[lo : hi - width + 1]))
            elif hi > lo:  # the whole sequence is one shingle, unlike any longer one
                h = np.uint64(hi - lo)
                for w in words[lo:hi]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w
                out.append(mix(np.array([h ^ np.uint64(0x5DEECE66D)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Least values of n hash functions over each set that isn't empty: n rows, a column a set."""
    a, b = functions(n)
    out = np.full((n, len(sets)), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= CHUNK):
            total += len(sets[to])
            to += 1
        values = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        offsets = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for lo in range(0, len(values), CHUNK):  # only a longer set needs more than one turn
            part = values[lo : lo + CHUNK]
            own = offsets if to > at + 1 or len(values) <= CHUNK else np.zeros(1, np.int64)
            t = np.empty_like(part)
            for k in range(n):
                np.multiply(part, a[k], out=t)
                np.add(t, b[k], out=t)
                least = np.minimum.reduceat(t, own)
                np.minimum(out[k, at:to], least, out=out[k, at:to])
        at = to
    return out


def make_sketch(width: int, bands: int, rows: int):
    def make(_):
        def kernel(texts: list[str | None]) -> list[list]:
            sets = shingle_sets(texts, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            out = [[len(s) for s in sets], *([None] * len(sets) for _ in range(3))]
            if full:
                least = minima([sets[i] for i in full], bands * rows)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, len(full)))
                    for r in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[r::rows])
                signature, keys = np.ascontiguousarray((least & 0xFF).astype(np.uint8).T), np.ascontiguousarray(key.view(np.int64).T)
                for j, i in enumerate(full):
                    out[1][i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    out[2][i] = keys[j]
                    out[3][i] = signature[j].tobytes()
            return out

        return kernel

    return make


def agree(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) with signatures sa and sb of which at least that share of bytes is equal."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                near = (x == y).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def make_confirm(width: int, percent: int):
    def make(_):
        def kernel(texts: list[str | None], others: list[str | None]) -> list[list]:
            x, y = shingle_sets(texts, width), shingle_sets(others, width)
            out = []
            for s, t in zip(x, y):
                both = len(s) + len(t) - len(np.union1d(s, t))
                out.append(len(s) > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            return [out]

        return kernel

    return make


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Columns id and root: for each end of a link the smallest id reachable.

    Large-star: each node's larger neighbours are linked to its smallest
    neighbour (or itself); small-star: its smaller neighbours and itself to the
    smallest of them. The two alternate until the links stay the same; each
    round's links, never more than a few a node, are written. Only their count
    and checksum come to the driver.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        release(edges)
        edges = following


def make_sets(width: int):
    def make(_):
        return lambda texts: [[x.view(np.int64) for x in shingle_sets(texts, width)]]

    return make


def make_key(width: int):
    """Only the digest of a text's set, as the sketches have it."""

    def make(_):
        return lambda texts: [[hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in shingle_sets(texts, width)]]

    return make


#: Sets from which a shingle counts as common; such shingles are few, and joined by broadcast.
COMMON = 1000


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """From (id, root, set): pairs (a, b) of different roots, all that reach the similarity and few others.

    Any two sets that do, the smaller y and the larger x, share a shingle among
    the |y| - 2p/(100+p) |y| + 1 rarest of y and the |x| - p/100 |x| + 1 rarest
    of x, and the first such shingle leaves enough places behind it. Rows of a
    shingle's commonest root are compared only with those of other roots.
    """
    sets = materialize(sets.select("id", "root", F.size("set").cast("long").alias("n"), "set"), "sets")
    rows = sets.select("id", F.explode("set").alias("shingle"))  # narrow: these rows are moved
    counts = materialize(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    common = bounded(counts.where(F.col("df") > COMMON))
    rare = rows.join(common.select("shingle"), "shingle", "left_anti").join(counts.where(F.col("df") <= COMMON), "shingle")
    own = Window.partitionBy("id")
    met = rows.join(common, "shingle").unionByName(rare).withColumn("rank", F.row_number().over(own.orderBy("df", "shingle"))).withColumn("met", F.count("*").over(own))
    # a set's shingles that no other set has come first; how many there are, its size tells
    probe, index = f"n - ({percent} * n + 99) div 100 + 1", f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1"
    prefix = met.join(sets.select("id", "root", "n"), "id").withColumn("place", F.expr("n - met + rank"))
    prefix = prefix.where(f"place <= {probe}").withColumn("indexed", F.expr(f"place <= {index}")).drop("df", "rank", "met")
    prefix = materialize(prefix, "prefixes")
    main = prefix.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    mixed = prefix.join(main.where("roots > 1").select("shingle", "main"), "shingle")
    mixed = materialize(mixed.withColumn("outside", F.col("root") != F.col("main")).drop("main"), "mixed")
    x, y = (mixed.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "root", "n", "place", "indexed", "outside"))) for side in "xy")
    fits = f"""root_x <> root_y and (n_y < n_x or n_y = n_x and id_y < id_x) and 100 * n_y >= {percent} * n_x
        and (100 + {percent}) * (1 + least(n_x - place_x, n_y - place_y)) >= {percent} * (n_x + n_y)"""
    y = y.where("indexed_y")
    found = x.where("outside_x").join(y, "shingle").where(fits).unionByName(x.where("not outside_x").join(y.where("outside_y"), "shingle").where(fits))
    pairs = materialize(found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), "crossing")
    release(sets, counts, prefix, mixed)
    return pairs


def _nodes(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Classes (set_key, least, node), copies (id, set_key) that don't stand, ids of several sets, and whether there are such ids.

    A class is named by its least id. Where an id is the least of several
    classes, all but one get a number beyond all ids.
    """
    named = base.where("id is not null and set_key is not null").select("id", "set_key")
    classes = materialize(named.groupBy("set_key").agg(F.min("id").alias("least")), "classes")
    copies = materialize(named.join(classes, "set_key").where("id <> least").select("id", "set_key").distinct(), "copies")
    part = F.xxhash64("set_key")
    several = materialize(named.groupBy("id").agg(F.min(part).alias("x"), F.max(part).alias("y")).where("x <> y").select("id"), "several")
    if several.isEmpty():
        return classes.withColumn("node", F.col("least")), copies, several, False
    shared = classes.join(bounded(several), classes["least"] == several["id"], "left_semi")
    heads = bounded(materialize(shared.groupBy("least").agg(F.min("set_key").alias("head")), "heads"))
    shared = shared.join(heads, "least").where("set_key <> head")
    top = named.agg(F.max("id")).first()[0] + 1
    numbered = materialize(shared.select("set_key", (F.lit(top) + F.monotonically_increasing_id()).alias("number")), "numbered")
    return classes.join(bounded(numbered), "set_key", "left").withColumn("node", F.coalesce("number", "least")).drop("number"), copies, several, True


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row for each row of docs: id, n_shingles, set_key, root (node of its text's component), component (of its id), and stands (the text stands for the component)."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    base = materialize(annotate(own, ["text"], make_sketch(width, bands, rows), FIELDS, keep=["id"]), "sketches")
    classes, copies, several, any_several = _nodes(base)
    standing = base.where("id is not null and set_key is not null").join(bounded(copies), ["id", "set_key"], "left_anti")  # one id of each class, its sketch unmoved if copies are few
    if any_several:
        again = classes.where("node <> least").select("set_key", "node")
        standing = standing.join(bounded(again), "set_key", "left").withColumn("id", F.coalesce("node", "id")).drop("node")

    members = standing.select("id", F.explode("buckets").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = materialize(members.join(crowded.select("bucket", "first"), "bucket"), "members")
    nodes = materialize(members.select("id").distinct(), "nodes")
    few = bounded(nodes)
    signatures = materialize(standing.join(few, "id", "left_semi").select("id", "signature").distinct(), "signatures")
    if any_several:  # which of its id's texts a node has, only the digest tells
        plain = own.join(bounded(several), "id", "left_anti")
        keyed = annotate(own.join(bounded(several), "id", "left_semi"), ["text"], make_key(width), [FIELDS[1]])
        keyed = keyed.join(classes.select("set_key", "node", F.col("least").alias("id")), ["set_key", "id"]).select(F.col("node").alias("id"), "text")
        texts = plain.unionByName(keyed).join(few, "id", "left_semi")
    else:
        texts = own.join(few, "id", "left_semi")
    texts = materialize(texts.distinct(), "texts")
    share = percent / 100
    expected = share + (1 - share) / 256
    least = expected - 5 * (expected * (1 - expected) / (bands * rows)) ** 0.5

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        signed = pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
        likely = materialize(agree(signed, least), f"likely-{name}")
        full = likely.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        found = annotate(full, ["ta", "tb"], make_confirm(width, percent), [T.StructField("linked", T.BooleanType())], keep=["a", "b"], where=0)
        links = materialize(found.select("a", "b").distinct(), f"links-{name}")
        release(likely)
        return links

    stars = materialize(members.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = confirmed(stars, "star")
    roots = components(links)
    placed = members.select("bucket", "id").join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    unlike = placed.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
    placed = materialize(placed.join(unlike, "bucket").select("id", "root").distinct(), "open")
    if not placed.isEmpty():
        open_ = texts.join(bounded(placed.select("id")), "id", "left_semi").join(placed, "id")
        sets = annotate(open_, ["text"], make_sets(width), [T.StructField("set", T.ArrayType(T.LongType(), False))], keep=["id", "root"])
        more = confirmed(prefix_pairs(sets, percent).join(stars, ["a", "b"], "left_anti"), "crossing")
        if not more.isEmpty():
            roots = components(_edges(roots).unionByName(more), "all")
        release(more)
    release(members, nodes, signatures, texts, stars, links, placed)
    found = base.select("id", "n_shingles", "set_key").join(classes, "set_key", "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    found = found.withColumn("root", F.coalesce("root", "node")).withColumn("stands", F.coalesce((F.col("node") == F.col("root")) & (F.col("id") == F.col("least")), F.lit(True)))
    if not any_several:
        release(copies, several)
        return found.select("id", "n_shingles", "set_key", "root", "stands", F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component"))
    found = materialize(found.select("id", "n_shingles", "set_key", "node", "root", "stands"), "placed")
    met = found.where("node is not null").join(bounded(several), "id", "left_semi").select("id", "node")
    met = met.join(met.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).where("a < b")
    whole = components(_edges(roots).unionByName(met), "ids").withColumnRenamed("root", "whole")
    release(copies, several)
    return found.join(whole.withColumnRenamed("id", "node"), "node", "left").select(
        "id", "n_shingles", "set_key", "root", "stands", F.when(F.col("id").isNotNull(), F.coalesce("whole", "root", "id")).alias("component")
    )


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest id reachable) and kept (it is its own component's)."""
    found = _placed(docs, id_col, text_col, width, percent, bands, rows).select("n_shingles", F.col("component").alias("component_id"), F.col("id").alias(id_col))
    return found.select(id_col, "n_shingles", "component_id", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of texts, with all its columns; the ids that go are broadcast only if few.

    Here an id with several texts is several documents, so that no text goes
    but for a near copy of it that stays. Of a standing id's rows with the same
    set of shingles one stays, and of the rows with a null id and the same set; of rows
    without words, one for each id and text, and all that have no id either. Which one is decided by the
    text and the other columns as text. Only rows of repeated ids are moved.
    """
    found = materialize(_placed(docs, id_col, text_col, width, percent, BANDS, ROWS).select("id", "set_key", "stands"), "decided")
    ids = found.groupBy("id").agg(F.bool_or("stands").alias("stands"), F.count("*").alias("n"))
    ids = materialize(ids.where("not stands or n > 1"), "gone")
    key, row, one = (unused(docs.columns, c) for c in ("set_key", "id", "one"))
    rows = docs.withColumn(row, F.col(f"`{id_col}`").cast("long"))
    rows = rows.join(bounded(ids.where("not stands").select(F.col("id").alias(row))), row, "left_anti")
    again = ids.where("stands").select(F.col("id").alias(row))
    if again.isEmpty():
        return rows.select(*_names(docs))
    again = bounded(materialize(again, "again"))
    same = rows[row].eqNullSafe(again[row])
    keyed = annotate(rows.join(again, same, "left_semi"), [text_col], make_key(width), [T.StructField(key, T.BinaryType())])
    wordless = F.col(key).isNull() & F.col(row).isNull()
    standing = found.where("stands and set_key is not null").select(F.col("id").alias(row), F.col("set_key").alias(key)).distinct()
    worded = keyed.where(F.col(key).isNotNull() & F.col(row).isNotNull()).join(standing.where(F.col(row).isNotNull()), [row, key], "left_semi")
    others = [F.col(f"`{c}`").cast("string") for c in [text_col, *(c for c in docs.columns if c not in (id_col, text_col))]]
    order = Window.partitionBy(row, key, F.when(F.col(key).isNull(), F.col(f"`{text_col}`"))).orderBy(*others, F.lit(0))
    rest = keyed.where((F.col(key).isNull() | F.col(row).isNull()) & ~wordless)
    single = worded.unionByName(rest).withColumn(one, F.row_number().over(order)).where(F.col(one) == 1)
    parts = [rows.join(again, same, "left_anti"), single, keyed.where(wordless)]
    return parts[0].select(*_names(docs)).unionByName(parts[1].select(*_names(docs))).unionByName(parts[2].select(*_names(docs)))


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]
