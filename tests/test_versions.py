import random

import pytest

from tidemark.functions import hashing
from tidemark.operators import access, scan, storage, versions, writes
from tidemark.streaming import feed

LOG = "cf string, key string, commit_ts long, seq int, op string, value string"


def log_of(spark, rows):
    return spark.createDataFrame([("default", k, ts, s, "DELETE" if v is None else "PUT", v) for k, ts, s, v in rows], LOG)


class Model:
    """The semantics in a dictionary: key -> versions in commit order."""

    def __init__(self, rows):
        self.rows = sorted(rows, key=lambda r: (r[1], r[2]))

    def at(self, snapshot=None):
        live = {}
        for k, ts, _, v in self.rows:
            if snapshot is None or ts <= snapshot:
                live[k] = v or None
        return {k: v for k, v in live.items() if v is not None}


def random_rows(seed, n=150):
    rng = random.Random(seed)
    seen, rows = set(), []
    for _ in range(n):
        k, ts, s = f"k{rng.randrange(12)}", rng.randrange(2, 60), rng.randrange(3)
        if (k, ts, s) not in seen:
            seen.add((k, ts, s))
            rows.append((k, ts, s, rng.choice([None, "", "v%d" % rng.randrange(99), "w"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_reads_equal_the_model(spark, seed):
    rows = random_rows(seed)
    model, log = Model(rows), log_of(spark, rows)
    for snapshot in (None, 0, 7, 30, 59):
        assert {r.key: r.value for r in versions.latest(log, snapshot).collect()} == model.at(snapshot)
    prefix = [r.key for r in scan.scan(log, "k1").collect()]
    assert prefix == sorted(k for k in model.at() if k.startswith("k1"))
    requests = [(i, f"k{i % 14}", i % 61) for i in range(60)]
    asked = spark.createDataFrame(requests, "req_id long, key string, snapshot_ts long")
    want = {i: model.at(s).get(k) for i, k, s in requests}
    for n, width in ((None, 1), (1 << 40, 7), (1 << 40, 1 << 20)):
        assert {r.req_id: r.value for r in versions.as_of(log, asked, n, width).collect()} == want
    last = [r for r in model.rows if not any(o[:2] == r[:2] and o[2] > r[2] for o in model.rows)]
    for width in (5, 1 << 20):
        got = versions.intervals(log_of(spark, last), width).collect()
        assert sorted((r.key, r.valid_from, r.value, r.valid_to) for r in got) == sorted(
            ((k, ts, v, min((o[1] for o in last if o[0] == k and o[1] > ts), default=None)) for k, ts, _, v in last if v), key=lambda r: r[:2]
        )


def test_families_are_keyspaces_of_their_own(spark):
    log = spark.createDataFrame([("a", "k", 5, 0, "PUT", "of a"), ("b", "k", 9, 0, "PUT", "of b"), ("default", "k", 7, 0, "PUT", "of default")], LOG)
    asked = spark.createDataFrame([(1, "a", "k", 10), (2, "b", "k", 8), (3, "b", "k", 9), (4, None, "k", 10), (5, "", "k", 6), (None, "a", "k", 10), (None, "b", "none", 10)], "req_id long, cf string, key string, snapshot_ts long")
    want = sorted([(1, "a", "of a"), (2, "b", None), (3, "b", "of b"), (4, "default", "of default"), (5, "default", None), (None, "a", "of a"), (None, "b", None)], key=str)
    for n, width in ((None, 1), (1 << 40, 3), (None, 1 << 20)):
        assert sorted(((r.req_id, r.cf, r.value) for r in versions.as_of(log, asked, n, width).collect()), key=str) == want
    assert [r.value for r in versions.as_of(log, asked.drop("cf").where("req_id = 1")).collect()] == ["of default"]
    pending = spark.createDataFrame([(20, 6, "a", "k", 0, "PUT", "x"), (21, 6, "b", "k", 0, "PUT", "y"), (22, 6, "", "k", 0, "PUT", "z")], "txn_id long, start_ts long, cf string, key string, seq int, op string, value string")
    assert {(r.txn_id, r.cf, r.commit_ts) for r in writes.conflicts(log, pending).collect()} == {(21, "b", 9), (22, "default", 7)}
    assert [r.txn_id for r in writes.clean(log, pending).collect()] == [20]
    reads = spark.createDataFrame([(20, 6, "a", "k"), (20, 6, "b", "k"), (22, 7, None, "k"), (20, 7, "default", "k")], "txn_id long, start_ts long, cf string, key string")
    got = {(r.txn_id, r.cf): (r.value, r.source) for r in writes.overlay(log, pending, reads).collect()}
    assert got == {(20, "a"): ("x", "pending"), (20, "b"): (None, "none"), (22, "default"): ("z", "pending"), (20, "default"): ("of default", "snapshot")}


def test_http_answers_in_pages(spark):
    import json

    rows = spark.createDataFrame([(f"k{i:03d}", f"v{i}") for i in range(45)], "key string, value string").repartition(5)
    pages = {r.page: json.loads(r.body) for r in scan.as_json(rows, "k", "mine", page=20).collect()}
    assert [len(pages[i]["items"]) for i in range(3)] == [20, 20, 5] and pages[1]["items"][0] == {"key": "k020", "value": "v20"}
    assert [json.loads(r.body) for r in scan.as_json(rows.limit(0), "x").collect()] == [{"cf": "default", "prefix": "x", "items": []}]


def test_subscribers_keep_their_own_places(spark, tmp_path):
    log_of(spark, random_rows(2)).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    sinks = [(str(tmp_path / f"out{i}"), str(tmp_path / f"cp{i}")) for i in range(2)]
    for q in feed.subscribe(feed.changes(feed.with_source(stream)), sinks):
        q.awaitTermination()
    log_of(spark, [("late", 99, 0, "x")]).write.mode("append").parquet(str(tmp_path / "log"))
    for q in feed.subscribe(feed.changes(feed.with_source(stream)), sinks[:1]):
        q.awaitTermination()
    n = len(random_rows(2))
    assert [spark.read.parquet(path).count() for path, _ in sinks] == [n + 1, n]
    assert spark.read.parquet(sinks[0][0]).select("source").distinct().count() == 1


def test_safe_compaction_changes_no_later_read(spark):
    rows = random_rows(5)
    log = log_of(spark, rows)
    for oldest in (0, 20, 59):
        kept = storage.compact_safe(log, oldest).select("cf", "key", "commit_ts", "seq", "op", "value").cache()
        for snapshot in (oldest, 40, 59, None):
            if snapshot is None or snapshot >= oldest:
                assert {r.key: r.value for r in versions.latest(kept, snapshot).collect()} == Model(rows).at(snapshot)
        kept.unpersist()


def test_tombstones_at_the_same_place_and_later(spark):
    log = log_of(spark, [("user1", 10, 0, "value1"), ("user1", 20, 0, "value2"), ("user1", 20, 1, None), ("user1", 30, 0, "value3")])
    read = lambda s: [r.value for r in scan.get(log, "user1", snapshot=s).collect()]
    assert (read(5), read(15), read(25), read(30), read(None)) == ([], ["value1"], [], ["value3"], ["value3"])


def test_batch_and_transaction_rules(spark):
    log = log_of(spark, [("key3", 2, 0, "x"), ("a", 3, 0, "1")])
    assert writes.next_ts(log) == 4 and writes.next_ts(log.limit(0)) == 2
    batch = spark.createDataFrame([("default", "key1", 0, "PUT", "1"), ("default", "key1", 1, "PUT", "2"), ("default", "key3", 2, "DELETE", None)], "cf string, key string, seq int, op string, value string")
    assert {r.key: r.value for r in versions.latest(writes.apply_batch(log, batch, 4)).collect()} == {"a": "1", "key1": "2"}
    pending = spark.createDataFrame([(10, 2, "a", 0, "PUT", "mine"), (11, 3, "a", 0, "DELETE", None)], "txn_id long, start_ts long, key string, seq int, op string, value string")
    assert [(r.txn_id, r.key, r.commit_ts) for r in writes.conflicts(log, pending).collect()] == [(10, "a", 3)]
    assert [r.txn_id for r in writes.clean(log, pending).collect()] == [11]
    reads = spark.createDataFrame([(10, 2, "a"), (10, 2, "key3"), (10, 2, "none"), (11, 3, "a")], "txn_id long, start_ts long, key string")
    got = {(r.txn_id, r.key): (r.value, r.source) for r in writes.overlay(log, pending, reads).collect()}
    assert got == {(10, "a"): ("mine", "pending"), (10, "key3"): ("x", "snapshot"), (10, "none"): (None, "none"), (11, "a"): (None, "pending")}


def test_binary_prefixes(spark):
    assert scan.successor(b"ab") == b"ac" and scan.successor(b"a\xff") == b"b" and scan.successor(b"\xff\xff") is None
    keys = [b"", b"a", b"a\xff", b"a\xff\x00", b"b", b"\xff\xff", b"\xff\xffz", b"\x7f", b"\x80"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    for prefix in (b"", b"a", b"a\xff", b"\xff", b"\xff\xff"):
        assert {bytes(r.key) for r in df.where(scan.has_prefix(df.key, prefix)).collect()} == {k for k in keys if k.startswith(prefix)}


def test_prefix_reaches_the_file_scan(spark, tmp_path):
    log = log_of(spark, random_rows(1))
    log.write.partitionBy("cf").parquet(str(tmp_path / "log"))
    plan = scan.scan(spark.read.parquet(str(tmp_path / "log")), "k1", snapshot=30)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,k1)" in plan and "LessThanOrEqual(commit_ts,30)" in plan and "WindowGroupLimit" in plan and "PartitionFilters: [isnotnull(cf" in plan


def test_manifest_and_value_log(spark):
    file = "file_num: bigint, level: int, min_key: string, max_key: string, size: bigint"
    edits = [(1, [(1, 0, "a", "b", 100), (2, 1, "c", "d", 200)], []), (2, [(2, 1, "c", "e", 250)], [(2, 1, None, None, None)]), (3, [], [(1, 0, None, None, None)])]
    df = spark.createDataFrame(edits, f"edit_seq long, new_files array<struct<{file}>>, deleted_files array<struct<{file}>>")
    files = storage.manifest_files(df)
    assert [tuple(r) for r in files.collect()] == [(1, 2, "c", "e", 250)]
    assert {tuple(r) for r in storage.inspect_levels(files).collect()} == {("1", 1, 250), ("total", 1, 250)}
    values = spark.createDataFrame([(i, 100 + i) for i in range(20)], "doc_id long, size long").repartition(3)
    laid = {r.doc_id: r.offset for r in storage.laid_out(values, "doc_id").collect()}
    assert laid == {i: 8 + sum(108 + j for j in range(i)) for i in range(20)}


def test_access(spark):
    F = __import__("pyspark.sql.functions", fromlist=["lit"])
    df = spark.createDataFrame([("/kv.Store/Get", ["readonly"], True), ("/kv.Store/Put", ["readonly"], False), ("/kv.Store/Authenticate", [], True), ("/kv.Store/ListCF", ["readwrite"], False), ("/kv.Store/DeleteCF", ["admin"], True), ("/kv.Store/Delete", ["readwrite"], True), ("x", None, False)], "m string, r array<string>, want boolean")
    assert all(r.got == r.want for r in df.select(access.may_call(F.col("m"), F.col("r")).alias("got"), "want").collect())
    df = spark.createDataFrame([("Bearer  abc ", "abc"), ("Basic x", ""), ("Bearer ", "")], "h string, want string")
    assert all(r.got == r.want for r in df.select(access.bearer(F.col("h")).alias("got"), "want").collect())
    paths = spark.createDataFrame([("/api/v1/kv/scan", "POST", 3), ("/api/v1/kv/x", "POST", 2), ("/api/v1/kv/x", "GET", 3), ("/api/v1/auth/login", "POST", 0), ("/api/v1/admin/users", "GET", 1), ("/other", "GET", 1)], "p string, v string, n int")
    assert all(r.got == r.n for r in paths.select(F.size(access.path_roles(F.col("p"), F.col("v"))).alias("got"), "n").collect())
    df = spark.createDataFrame([(" Bob ", "admin, readonly,,", "/api/v1/kv/a/b"), ("x", "", "/api/v1/kv/")], "n string, r string, p string")
    got = [tuple(r) for r in df.select(access.user_key(F.col("n")), access.role_list(F.col("r")), access.path_key(F.col("p"))).collect()]
    assert got == [("user:bob", ["admin", "readonly"], "a/b"), ("user:x", [], None)]
    row = spark.range(1).select(access.error_code(F.lit(401)).alias("a"), access.error_code(F.lit(403)).alias("b"), access.error_code(F.lit(500)).alias("c"), access.has_all(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("d")).first()
    assert tuple(row) == ("UNAUTHORIZED", "FORBIDDEN", "AUTH_ERROR", True)


def test_hashes(spark):
    F = __import__("pyspark.sql.functions", fromlist=["lit"])
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "k string")
    assert [r.h for r in df.select(hashing.fnv1a32(F.col("k")).alias("h")).collect()] == [2166136261, 0xE40C292C, 0xBF9CF968, None]


def test_feed_leaves_empty_values_out(spark):
    log = log_of(spark, [("a", 2, 0, "x"), ("a", 3, 0, None), ("b", 4, 0, "")])
    lines = {r.line for r in feed.as_json(feed.changes(log)).collect()}
    assert lines == {'{"event":"key_updated","key":"a","value":"x","cf":"default"}', '{"event":"key_deleted","key":"a","cf":"default"}', '{"event":"key_updated","key":"b","cf":"default"}'}


def test_stream_keeps_the_newest_in_any_order(spark, tmp_path):
    rows = random_rows(9)
    random.Random(1).shuffle(rows)
    for i in range(3):
        log_of(spark, rows[i::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    feed.run_once(feed.latest_view(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "complete")
    got = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.value is not None}
    assert got == Model(rows).at()
