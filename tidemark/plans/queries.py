"""One query for each operator of the store, over logs derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import access, scan, storage, versions, writes
from tidemark.sources import fixtures as fx
from tidemark.sources import native
from tidemark.sources.shared import scratch
from tidemark.sources.store import Store
from tidemark.sources.users import Users
from tidemark.streaming import feed

SNAPSHOT = 700
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def kv_get(spark, sf):
    return scan.get(fx.kv_events(spark, sf), "user:7")


@query
def kv_get_at(spark, sf):
    return scan.get(fx.kv_events(spark, sf), "user:7", snapshot=SNAPSHOT)


@query
def kv_latest_info(spark, sf):
    return versions.latest_info(fx.kv_events(spark, sf)).select("key", "value", "commit_ts")


@query
def kv_scan_all(spark, sf):
    return scan.scan(fx.kv_events(spark, sf))


@query
def kv_scan_prefix(spark, sf):
    return scan.scan(fx.kv_events(spark, sf), "user:1")


@query
def kv_scan_at(spark, sf):
    return scan.scan(fx.kv_events(spark, sf), "user:1", snapshot=SNAPSHOT)


@query
def kv_scan_binary(spark, sf):
    log = fx.kv_events(spark, sf).withColumn("key", F.col("key").cast("binary"))
    return scan.scan(log, b"user:1").select(F.col("key").cast("string").alias("key"), "value")


@query
def kv_scan_observed(spark, sf):
    return scan.observed_scan(fx.kv_events(spark, sf), "user:1")


@query
def kv_history(spark, sf):
    return versions.history(fx.kv_events(spark, sf))


@query
def kv_validity_intervals(spark, sf):
    return versions.intervals(fx.kv_events(spark, sf)).drop("cf")


@query
def asof_get(spark, sf):
    return versions.as_of(fx.kv_events(spark, sf), fx.requests(spark, sf)).select("req_id", "key", "snapshot_ts", "value", "commit_ts")


@query
def asof_get_merged(spark, sf):
    """The same by merging log and requests, as for many requests."""
    return versions.as_of(fx.kv_events(spark, sf), fx.requests(spark, sf), n_requests=1 << 40).select("req_id", "key", "snapshot_ts", "value", "commit_ts")


@query
def cf_list(spark, sf):
    return scan.families(fx.kv_all(spark, sf))


@query
def cf_stats(spark, sf):
    return scan.stats(fx.kv_all(spark, sf))


@query
def cf_scan(spark, sf):
    return scan.scan(fx.kv_all(spark, sf), "cust:00000", "orders")


@query
def merge_runs(spark, sf):
    runs = fx.runs(spark, sf)
    return storage.merge_runs([runs.where(F.col("run") == i).drop("run") for i in range(4)]).select("key", "value", "commit_ts")


@query
def run_key_ranges(spark, sf):
    return storage.run_ranges(fx.runs(spark, sf))


@query
def file_pruning(spark, sf):
    return storage.may_hold(storage.manifest_files(fx.manifest_edits(spark, sf)), "0000150")


@query
def last_commit_per_key(spark, sf):
    return versions.last_commit(fx.kv_events(spark, sf)).drop("cf")


@query
def batch_apply(spark, sf):
    log = fx.kv_events(spark, sf)
    return versions.latest(writes.apply_batch(log, fx.batch(spark, sf), writes.next_ts(log))).select("key", "value", "commit_ts")


@query
def cf_batch_apply(spark, sf):
    log = fx.kv_all(spark, sf)
    return versions.latest(writes.apply_batch(log, fx.cf_batch(spark, sf), writes.next_ts(log)))


@query
def txn_overlay_read(spark, sf):
    return writes.overlay(fx.kv_events(spark, sf), fx.txn_writes(spark, sf), fx.txn_reads(spark, sf)).drop("cf")


@query
def txn_conflicts(spark, sf):
    return writes.conflicts(fx.kv_events(spark, sf), fx.txn_writes(spark, sf)).drop("cf")


@query
def txn_clean(spark, sf):
    return writes.clean(fx.kv_events(spark, sf), fx.txn_writes(spark, sf))


@query
def asof_get_cf(spark, sf):
    """As-of reads in families that have keys of the same names."""
    asked = fx.in_family(fx.requests(spark, sf), "req_id")
    return versions.as_of(fx.kv_families(spark, sf), asked).select("req_id", "cf", "key", "snapshot_ts", "value", "commit_ts")


@query
def txn_conflicts_cf(spark, sf):
    return writes.conflicts(fx.kv_families(spark, sf), fx.in_family(fx.txn_writes(spark, sf), "txn_id"))


@query
def txn_overlay_cf(spark, sf):
    return writes.overlay(fx.kv_families(spark, sf), fx.in_family(fx.txn_writes(spark, sf), "txn_id"), fx.in_family(fx.txn_reads(spark, sf), "txn_id"))


@query
def version_rank(spark, sf):
    return versions.ranks(fx.kv_families(spark, sf)).select("cf", "key", "commit_ts", F.col("rank").cast("long").alias("rank"))


@query
def recent_ops(spark, sf):
    """The last 100 operations."""
    return versions.recent(fx.kv_events(spark, sf)).select("key", "commit_ts", "op")


@query
def compact_documented(spark, sf):
    log = fx.kv_events(spark, sf)
    return storage.compact_documented(log, storage.min_snapshot(log)).select("key", "commit_ts", "op", "value")


@query
def compact_safe(spark, sf):
    log = fx.kv_events(spark, sf)
    return storage.compact_safe(log, storage.min_snapshot(log)).select("key", "commit_ts", "op", "value")


@query
def wal_replay(spark, sf):
    return versions.latest(storage.replay(fx.wal(spark, sf))).select("key", "value", "commit_ts")


@query
def manifest_levels(spark, sf):
    return storage.manifest_files(fx.manifest_edits(spark, sf))


@query
def inspect_levels(spark, sf):
    return storage.inspect_levels(storage.manifest_files(fx.manifest_edits(spark, sf)))


@query
def level_order(spark, sf):
    """Each file's place in its level, by least key."""
    return storage.level_places(storage.manifest_files(fx.manifest_edits(spark, sf))).select("level", "file_num", F.col("place").cast("long").alias("place"))


@query
def oldest_snapshot(spark, sf):
    return storage.oldest_snapshot(fx.txn_writes(spark, sf))


@query
def value_checksums(spark, sf):
    return fx.kv_events(spark, sf).where("value is not null").select("commit_ts", storage.frame_checksum(F.col("value")).alias("crc32"))


@query
def user_keys(spark, sf):
    named = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"))
    path = F.concat(F.lit("/api/v1/kv/"), access.user_key(F.col("name")))
    return named.select("c_custkey", access.user_key(F.col("name")).alias("key"), access.path_key(path).alias("path_key"))


@query
def value_separation(spark, sf):
    return fx.kv_docs(spark, sf).select("key", F.octet_length("value").cast("long").alias("n_bytes"), storage.placement(F.col("value")).alias("placement"))


def _vlog(spark, sf):
    vlog = storage.laid_out(fx.big_values(spark, sf), "doc_id")
    return vlog, vlog.join(fx.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query
def vlog_deref(spark, sf):
    vlog, _ = _vlog(spark, sf)
    pointers = vlog.select(F.when(F.col("doc_id") % 7 == 0, F.col("offset") + 1).otherwise(F.col("offset")).alias("offset"), "size")
    return storage.vlog_deref(pointers, vlog)


@query
def vlog_live(spark, sf):
    return storage.vlog_live(*_vlog(spark, sf)).select("doc_id", "offset", "size")


@query
def vlog_garbage(spark, sf):
    return storage.vlog_garbage(*_vlog(spark, sf)).select("doc_id", "offset", "size")


@query
def vlog_relocate(spark, sf):
    return storage.vlog_relocate(*_vlog(spark, sf)).select("old_offset", "new_offset", "size")


@query
def users_from_kv(spark, sf):
    return access.users(fx.auth_log(spark, sf)).select("username", F.array_join("roles", ",").alias("roles"), "created_at")


@query
def authz_matrix(spark, sf):
    return access.matrix(access.users(fx.auth_log(spark, sf)))


@query
def jwt_claims(spark, sf):
    people = access.users(fx.auth_log(spark, sf))
    payload = F.to_json(F.struct(F.col("username").alias("sub"), "roles", (F.col("created_at") + 86400).alias("exp"), F.col("created_at").alias("iat")))
    header = F.concat(F.lit("Bearer "), access.token(F.lit('{"alg":"HS256","typ":"JWT"}'), payload, F.lit("signature")))
    read = people.select(access.claims(access.bearer(header)).alias("c"))
    return read.select("c.sub", F.array_join("c.roles", ",").alias("roles"), "c.exp", "c.iat")


@query
def role_lists(spark, sf):
    """Roles given as text, and what of them is valid."""
    text = F.expr("concat(' admin, ', lower(c_mktsegment), ',,readonly ', if(c_custkey % 2 = 0, ',readwrite', ''))")
    named = fx.table(spark, sf, "customer").select("c_custkey", access.role_list(text).alias("roles"))
    valid = F.filter("roles", access.valid_role)
    writes_ = access.has_all(F.col("roles"), F.array(F.lit("admin"), F.lit("readwrite")))
    return named.select("c_custkey", F.array_join("roles", "|").alias("roles"), F.array_join(valid, "|").alias("valid"), writes_.alias("has_both"))


@query
def path_rules(spark, sf):
    """Roles of which a path and verb ask one, for keys of all kinds."""
    verbs = F.explode(F.array(*map(F.lit, ("GET", "PUT", "POST", "DELETE", "PATCH")))).alias("verb")
    path = F.expr("case c_custkey % 4 when 0 then '/api/v1/kv/scan' when 1 then concat('/api/v1/kv/k', c_custkey) when 2 then '/api/v1/auth/login' else '/api/v1/admin/users' end").alias("path")
    asked = fx.table(spark, sf, "customer").select("c_custkey", path, verbs)
    return asked.select("c_custkey", "verb", F.array_join(access.path_roles(F.col("path"), F.col("verb")), ",").alias("roles"))


@query
def error_codes(spark, sf):
    status = F.expr("case c_custkey % 3 when 0 then 401 when 1 then 403 else 500 end")
    return fx.table(spark, sf, "customer").select("c_custkey", access.error_code(status).alias("code"))


@query
def droppable_families(spark, sf):
    """All families, and whether they may be dropped."""
    named = scan.families(fx.kv_all(spark, sf).unionByName(fx.auth_log(spark, sf)))
    return named.select("cf", (~F.col("cf").isin(*scan.SYSTEM)).alias("droppable"))


@query
def scan_total(spark, sf):
    return scan.total(scan.scan(fx.kv_events(spark, sf), "user:1"))


@query
def rest_scan_body(spark, sf):
    """A prefix scan's whole answer, in pages of 20 items."""
    return scan.as_json(scan.scan(fx.kv_events(spark, sf), "user:1"), "user:1", page=20)


@query
def change_feed_source(spark, sf):
    """Events that tell single puts and deletes from those of batches and transactions."""
    log = fx.kv_events(spark, sf)
    batches, txns = log.where("commit_ts % 10 = 3"), log.where("commit_ts % 10 = 7")
    return feed.changes(feed.with_source(log, batches, txns))


@query
def change_feed(spark, sf):
    return feed.changes(fx.kv_events(spark, sf))


@query
def rest_scan_json(spark, sf):
    """A prefix scan as lines of JSON, an item a line."""
    return scan.scan(fx.kv_events(spark, sf), "user:1").select(F.to_json(F.struct("key", "value")).alias("item"))


@query
def export_tsv(spark, sf):
    return scan.as_tsv(scan.scan(fx.kv_events(spark, sf), "user:"))


@query
def ts_invert(spark, sf):
    return fx.kv_events(spark, sf).select("key", hashing.inverted(F.col("commit_ts")).alias("inverted_ts"))


@query
def bloom_bits(spark, sf):
    """Keys and the bits they set in a file's filter."""
    keys = fx.kv_events(spark, sf).select("key").distinct()
    return keys.select("key", hashing.fnv1a32(F.col("key")).alias("fnv1a32"), F.array_join(hashing.bloom_positions(F.col("key")).cast("array<string>"), ",").alias("bits"))


@query
def filter_membership(spark, sf):
    """Filters of 64 small runs, asked for every key: no key of a run is ever turned away."""
    log = fx.kv_events(spark, sf).select("key", (F.col("commit_ts") % 64).alias("run"))
    filters = hashing.filter_words(log.where("run < 8").distinct(), ["run"])
    asked = log.select("key").distinct().withColumn("places", hashing.bloom_positions(F.col("key")))  # once a key, before runs multiply it
    asked = asked.select("key", "places", F.explode(F.expr("sequence(0L, 7L)")).alias("run"))
    return asked.join(F.broadcast(filters), "run").select("run", "key", hashing.passes(F.col("words"), F.col("places")).alias("may_contain"))  # 8 filters


def _native(spark, log, name):
    """A store's folder of its own files, laid down from a log: older versions in tables, the later half in write-ahead logs."""
    at = scratch(spark, name)
    native.write_store(log, at, storage.min_snapshot(log))
    return at


@query
def native_store(spark, sf):
    """Live keys of all families, read from a store's own files."""
    log = fx.kv_families(spark, sf).unionByName(fx.kv_docs(spark, sf))
    read = versions.latest(native.read_store(spark, _native(spark, log, "store")))
    return read.select("cf", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "commit_ts")


@query
def native_history(spark, sf):
    """All versions, read from a store's own files."""
    read = native.read_store(spark, _native(spark, fx.kv_events(spark, sf), "history"))
    return read.select("cf", F.col("key").cast("string").alias("key"), "commit_ts", "op", F.col("value").cast("string").alias("value"))


@query
def native_tables(spark, sf):
    """What the footers, bounds and filters of a family's tables tell, together with its manifest."""
    at = _native(spark, fx.kv_events(spark, sf), "tables") + "/default"
    info = native.table_info(spark, f"{at}/*.sst").withColumn("file_num", F.regexp_extract("path", r"(\d+)\.sst$", 1).cast("long"))
    files = storage.manifest_files(native.read_manifest(spark, f"{at}/MANIFEST"))
    both = files.join(info.select("file_num", "n_entries", "bits", F.col("min_key").cast("string").alias("least"), F.col("max_key").cast("string").alias("greatest")), "file_num")
    agree = F.bool_and((F.col("min_key") == F.col("least")) & (F.col("max_key") == F.col("greatest")) & hashing.may_contain(F.col("bits"), F.col("least")) & hashing.may_contain(F.col("bits"), F.col("greatest")))
    return both.agg(F.sum("n_entries").alias("n_entries"), F.min("least").alias("min_key"), F.max("greatest").alias("max_key"), agree.alias("agree"))


@query
def store_commits(spark, sf):
    """The verbs of a durable store: families, batches, single ops, a transaction, a drop, a vacuum; what is live afterwards."""
    store = Store(spark, scratch(spark, "commits"))
    for cf in ("nations", "gone"):
        store.create_cf(cf)
    nation, region = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    op = lambda cf, key, value: [F.lit(cf).alias("cf"), key.alias("key"), F.lit(0).alias("seq"), F.lit("PUT").alias("op"), value.alias("value")]
    store.append(nation.select(*op("nations", F.col("n_name"), F.col("n_nationkey").cast("string"))).unionByName(region.select(*op("", F.col("r_name"), F.lit("first")))))
    store.put("x", "lost", "gone")
    store.append(region.where("r_regionkey % 2 = 0").select(*op("default", F.col("r_name"), F.lit("second"))))
    store.delete("ASIA")
    store.batch("nations").add_put("NATION_3", "a").add_put("NATION_3", "b").add_delete("NATION_4").add_put("EUROPE", "here", "").commit()
    txn = store.transaction("nations")
    txn.put("NATION_5", "txn")
    store.drop_cf("gone")
    store.vacuum()
    txn.commit()
    return versions.latest(store.log())


@query
def user_accounts(spark, sf):
    """Accounts kept in a store: created, changed, deleted, listed."""
    users = Users(Store(spark, scratch(spark, "users")), b"key of this test")
    for r in fx.table(spark, sf, "region").orderBy("r_regionkey").collect():  # five rows
        users.create(f" {r.r_name} ", "password", ["admin"] if r.r_regionkey == 0 else ["readonly", "readwrite"][: r.r_regionkey])
    users.update_roles("asia", ["readwrite"])
    users.delete("europe")
    return users.list().select("username", F.array_join("roles", ",").alias("roles"))


def _stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return events.select(
        F.lit("default").alias("cf"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        (F.col("event_id") + 2).alias("commit_ts"),
        F.lit(0).alias("seq"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.expr("case when event_type = 'error' then null when event_id % 101 = 0 then '' else props end").alias("value"),
    )


@query
def change_feed_stream(spark, sf):
    """The change feed by Structured Streaming, of what is there."""
    at = scratch(spark, "feed")
    feed.run_once(feed.changes(_stream(spark, sf)), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query
def latest_view_stream(spark, sf):
    """The newest version of each key, kept by a stream."""
    at = scratch(spark, "view")
    feed.run_once(feed.latest_view(_stream(spark, sf)), f"{at}/out", f"{at}/checkpoint", "complete")
    return spark.read.parquet(f"{at}/out").drop("cf")
