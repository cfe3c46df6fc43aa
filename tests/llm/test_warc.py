import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import warc


def laid(spark, rows, name):
    """An index of (id, size, content) rows."""
    df = spark.createDataFrame([(i, n, hashlib.sha256(c.encode()).hexdigest()) for i, n, c in rows], "id long, size long, digest string")
    return warc.index(df, name)


def brute(first, second):
    found = {}
    for i in {r[0] for r in first + second}:
        x, y = (Counter(c for j, _, c in rows if j == i) for rows in (first, second))
        lost, new = sum((x - y).values()), sum((y - x).values())
        if lost or new:
            found[i] = ("changed" if lost and new else "missing" if lost else "extra", max(lost, new))
    return found


def test_audit_finds_all_damage_and_nothing_else(spark, monkeypatch):
    """Equal lengths and others, losses, insertions, repeated ids, null and negative ids, over several files; shifted records are whole."""
    rng = random.Random(1)
    first = [(i, rng.randrange(100, 400), f"c{i}") for i in [None, None, -5, -1, *range(60), 7, 7, 8]]
    first = [(i, n, f"{c}-{k % 2 if i == 7 else 0}") for k, (i, n, c) in enumerate(first)]
    second = [r for r in first if r[0] not in (11, 40)]
    second = [(i, n + 9 if i == 20 else n, "other" if i in (20, 21) else c) for i, n, c in second]
    second += [(33, 150, "inserted"), (None, 100, "no id"), (8, 120, "x"), (900, 130, "y")]
    rng.shuffle(second)
    monkeypatch.setattr(warc, "FILE_IDS", 25)
    a, b = laid(spark, first, "a"), laid(spark, second, "b")
    assert a.count() == len(first)
    for width, fanout in ((250, 64), (1 << 18, 256)):
        got = {r.id: (r.problem, r.n) for r in warc.audit(a, b, width, fanout).collect()}
        assert got == brute(first, second)
        assert warc.audit(a, a, width, fanout).count() == 0
    places = {(r.id, r.file, r.offset) for r in a.collect()}
    assert all((r.id, r.file, r.offset) in places for r in warc.audit(a, b).collect() if r.problem != "extra")


def test_only_the_files_that_differ_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_IDS", 10)
    first = [(i, 200, f"c{i}") for i in range(200)]
    second = [(i, n + (i == 55), c + ("!" if i == 55 else "")) for i, n, c in first]  # one record has grown: its file shifts
    a, b = laid(spark, first, "a"), laid(spark, second, "b")
    side = lambda df, k: df.select(F.lit(k).alias("replica"), "at", "digest", "id")
    met = warc.suspects(side(a, 0).unionByName(side(b, 1)), 500, 16).collect()
    assert {r.id for r in met} <= set(range(50, 60)) and 55 in {r.id for r in met}
    assert [(r.id, r.problem) for r in warc.audit(a, b, 500, 16).collect()] == [(55, "changed")]


def test_roots_equal_brute_force(spark):
    at = [i * 100 for i in range(50)]
    nodes = {o: hashlib.sha256(str(o).encode()).hexdigest() for o in at}
    leaves = spark.createDataFrame([(0, o, d) for o, d in nodes.items()], "replica int, at long, digest string")
    for width in (1000, 4, 4):
        groups = {}
        for at in sorted(nodes):
            groups.setdefault(at // width, []).append(f"{at}:{nodes[at]}")
        nodes = {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in groups.items()}
    top = warc.build(leaves, 1000, 4)[-1].collect()
    assert {(r["at"], r.digest) for r in top} == set(nodes.items()) and len(top) == 1


def test_records_and_offsets(spark):
    rows = [(2, "u2", "bödy"), (1, None, None), (None, "u", "x"), (2, "u2", "bödy")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = df.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    texts = {r.page_id: r.r for r in made.collect()}
    assert "Content-Length: 5\r\n\r\nbödy\r\n\r\n" in texts[2] and "Content-Length: 0\r\n\r\n\r\n\r\n" in texts[1]
    out = warc.index(made.select(F.col("page_id").alias("id"), F.octet_length("r").cast("long").alias("size"), F.sha2("r", 256).alias("digest"))).collect()
    at = {}
    for r in sorted(out, key=lambda r: r["at"]):
        assert r.offset == at.setdefault(r.file, 0)
        at[r.file] += r["size"]
        assert r.file == (-1 if r.id is None else 0)
    assert len(out) == 4
    empty = laid(spark, [], "empty")
    assert warc.audit(empty, empty).count() == 0


def test_headers(spark):
    """A date, an id of its own for each different record, and no line of a url's own."""
    rows = [(1, "http://a\r\nX-Evil: 1", "b"), (1, "http://a", "b"), (1, "http://a", "c"), (1, "http://a", "c")]
    made = [r.r for r in spark.createDataFrame(rows, "i long, u string, b string").select(warc.record(F.col("i"), F.col("u"), F.col("b")).alias("r")).collect()]
    ids = [re.search(r"WARC-Record-ID: <urn:md5:([0-9a-f]{32})>", r)[1] for r in made]
    assert len(set(ids)) == 3 and ids[2] == ids[3]
    assert all(r.split("\r\n")[3] == f"WARC-Date: {warc.DATE}" and len(r.split("\r\n\r\n")[0].split("\r\n")) == 7 for r in made)
    damaged = spark.range(1).select(warc.record(F.lit(1), F.lit("http://a"), F.lit("b"), F.lit("zz")).alias("r")).first().r
    assert damaged == made[1].replace("\r\n\r\nb", "\r\n\r\nzz")


def test_very_long_pages(spark):
    rows = [(1, "u", "x" * 30_000_000), (2, "u", None), (3, "u", "y" * 20_000_000)]
    df = spark.createDataFrame(rows, "i long, u string, b string")
    made = df.select(F.col("i").alias("id"), warc.record(F.col("i"), F.col("u"), F.col("b")).alias("r")).select("id", F.octet_length("r").cast("long").alias("size"), F.sha2("r", 256).alias("digest"))
    whole = warc.index(made, "whole")
    broken = warc.index(made.withColumn("digest", F.when(F.col("id") == 3, "0").otherwise(F.col("digest"))), "broken")
    assert [(r.id, r.problem) for r in warc.audit(whole, broken).collect()] == [(3, "changed")]
