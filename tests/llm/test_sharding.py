import zlib

from tidemark.llm import sharding


def check(rows, out, n):
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 8) for i, t in rows)
    total, shards = sum(r["size"] for r in out), {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    widest = max(r["size"] for r in out)
    for k in range(n):
        own = sorted(shards.get(k, []), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= widest + 1
    order = [r.doc_id for k in sorted(shards) for r in sorted(shards[k], key=lambda r: r.slot) if r.doc_id is not None]
    assert order == sorted(order)


def test_shards_are_contiguous_and_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = sharding.shard_by_bytes(docs).collect()
    check(rows, out, 24)
    crc = {i: zlib.crc32(t.encode()) for i, t in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in out)


def test_edges(spark):
    rows = [(1, None), (1, ""), (None, "x"), (7, "é" * 40)] + [(3, "same")] * 60
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, size string").repartition(3)
    check(rows, sharding.shard_by_bytes(df, 5).collect(), 5)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0
    assert [r.shard for r in sharding.shard_by_bytes(df.limit(1), 4).collect()] == [2]


def test_very_long_texts(spark):
    rows = [(i, "é" * 10_000_000 if i == 5 else f"text {i}") for i in range(40)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, out, 4)
    assert next(r for r in out if r.doc_id == 5).text_crc32 == zlib.crc32(rows[5][1].encode())
