"""DuckDB SQL for each query, on the same tables."""

from __future__ import annotations

from tidemark.operators.access import METHODS
from tidemark.plans.queries import SNAPSHOT

_EVENTS = """kv_events as (select 'default' as cf, concat('user:', user_id) as key, event_id + 2 as commit_ts, 0 as seq,
  case when event_type = 'error' then 'DELETE' else 'PUT' end as op,
  case when event_type = 'error' then null when event_id % 101 = 0 then '' else props end as value from events)"""
_ORDERS = """kv_orders as (select 'orders' as cf, concat('cust:', lpad(cast(o_custkey as varchar), 7, '0'), ':order:', lpad(cast(o_orderkey as varchar), 9, '0')) as key,
  o_orderkey + 2 as commit_ts, 0 as seq, 'PUT' as op, concat(o_orderstatus, '|', o_orderpriority) as value from orders)"""
_DOCS = """kv_docs as (select 'docs' as cf, concat('doc:', lang, ':', lpad(cast(doc_id as varchar), 9, '0')) as key, doc_id + 2 as commit_ts, 0 as seq, 'PUT' as op, text as value from documents)"""
_ALL = f"{_EVENTS}, {_ORDERS}, {_DOCS}, kv_all as (select * from kv_events union all select * from kv_orders union all select * from kv_docs)"
_BATCH = """batch as (select 'default' as cf, concat('user:', user_id) as key, event_id as seq, case when event_id % 20 = 3 then 'PUT' else 'DELETE' end as op,
  case when event_id % 20 = 3 then concat('batch-', event_id) end as value from events where event_id % 10 = 3)"""
_WRITES = """txn_writes as (select event_id as txn_id, event_id + 2 - 40 as start_ts, concat('user:', user_id + i) as key,
  case when i = 1 and event_id % 2 = 0 then 'DELETE' else 'PUT' end as op, case when i = 1 and event_id % 2 = 0 then null else concat('txn-', event_id) end as value
  from events, (select unnest([0, 1]) as i) where event_id % 97 = 0)"""
_FILES = """edits as (select o_orderkey as e, o_orderkey % 3 as level, lpad(cast(o_custkey as varchar), 7, '0') as min_key, lpad(cast(o_custkey + 100 as varchar), 7, '0') as max_key,
  cast(floor(o_totalprice) as bigint) as size from orders),
files as (select cast(level as integer) as level, e as file_num, min_key, max_key, size from edits a where not exists (select 1 from edits b where b.e % 5 = 0 and b.e - 3 = a.e))"""
_VLOG = """vlog as (select doc_id, strlen(text) as size, cast(8 + coalesce(sum(8 + strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from documents where strlen(text) > 64)"""
_USERS = """users as (select lower(trim(c_name)) as username, case c_mktsegment when 'AUTOMOBILE' then 'admin' when 'BUILDING' then 'readwrite' when 'FURNITURE' then 'readonly'
  when 'HOUSEHOLD' then 'readwrite,readonly' else '' end as roles, c_custkey + 1700000000 as created_at from customer where c_custkey % 50 <> 49)"""


_FAMILIES = f"""{_EVENTS}, {_ORDERS}, kv_families as (select * from kv_events union all select 'mirror', key, commit_ts * 2 - 1, seq, op, case when value is not null then concat('m', value) end from kv_events union all select * from kv_orders)"""
_CF = "case when {0} % 3 <> 0 and {0} % 2 = 0 then 'mirror' else 'default' end as cf"
_BITS = """k as (select distinct key from kv_events),
  h as (select key, list_reduce(list_prepend(cast(2166136261 as bigint), [cast(ascii(c) as bigint) for c in string_split(key, '')]), lambda a, b: (xor(a, b) * 16777619) & 4294967295) as fnv1a32 from k),
  bits as (select key, fnv1a32, [((fnv1a32 + i * xor(fnv1a32, cast(3164544308 as bigint))) & 4294967295) % 8192 for i in range(10)] as bits from h)"""


def _newest(log: str, where: str = "true") -> str:
    """Ranked versions of a log; rank 1 is the newest."""
    return f"""ranked as (select cf, key, commit_ts, seq, case when op = 'PUT' and strlen(value) > 0 then 'PUT' else 'DELETE' end as op, case when op = 'PUT' and strlen(value) > 0 then value end as value,
      row_number() over (partition by cf, key order by commit_ts desc, seq desc) as rank from {log} where {where}),
    live as (select cf, key, value, commit_ts from ranked where rank = 1 and op = 'PUT')"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts)


_E = _with(_EVENTS, _newest("kv_events"))
_ASOF = _with(_EVENTS) + """, r as (select event_id as req_id, concat('user:', (user_id * 7) % 200) as key, event_id as snapshot_ts from events where event_id % 50 = 0)
select req_id, r.key, snapshot_ts, case when op = 'PUT' and strlen(value) > 0 then value end as value, commit_ts
from r asof left join kv_events v on r.key = v.key and r.snapshot_ts >= v.commit_ts"""
_CONFLICTS = """, c as (select txn_id, w.key, max(commit_ts) as commit_ts from txn_writes w join kv_events v on v.key = w.key and v.commit_ts > w.start_ts and v.commit_ts < w.txn_id + 2 group by all)"""
_READS = ["Get", "Scan"]
_ALLOWED = f"""case when method like '%Authenticate' then true
  when method in ('Get', 'Scan') then list_has_any(string_split(roles, ','), ['readonly', 'readwrite', 'admin'])
  when method in ('Put', 'Delete', 'BeginTxn', 'CommitTxn', 'RollbackTxn') then list_has_any(string_split(roles, ','), ['readwrite', 'admin'])
  else list_has_any(string_split(roles, ','), ['admin']) end"""
_FEED = _with(_EVENTS) + " select case when op = 'PUT' then 'key_updated' else 'key_deleted' end as event, cf, key, nullif(value, '') as value, commit_ts from kv_events"
_INFO = _E + " select key, value, commit_ts from ranked where rank = 1"

ORACLE_SQL: dict[str, str] = {
    "kv_get": _E + " select key, value from live where key = 'user:7'",
    "kv_get_at": _with(_EVENTS, _newest("kv_events", f"commit_ts <= {SNAPSHOT}")) + " select key, value from live where key = 'user:7'",
    "kv_latest_info": _INFO,
    "kv_scan_all": _E + " select key, value from live",
    "kv_scan_prefix": _E + " select key, value from live where starts_with(key, 'user:1')",
    "kv_scan_at": _with(_EVENTS, _newest("kv_events", f"commit_ts <= {SNAPSHOT}")) + " select key, value from live where starts_with(key, 'user:1')",
    "kv_scan_binary": _E + " select key, value from live where starts_with(key, 'user:1')",
    "kv_scan_observed": _with(_EVENTS) + " select key, arg_min(value, commit_ts) as value from kv_events where op = 'PUT' and value <> '' and starts_with(key, 'user:1') group by key",
    "kv_history": _with(_EVENTS) + " select * from kv_events",
    "kv_validity_intervals": _with(_EVENTS)
    + """, s as (select *, lead(commit_ts) over (partition by key order by commit_ts) as valid_to from kv_events)
      select key, value, commit_ts as valid_from, valid_to from s where op = 'PUT' and value <> ''""",
    "asof_get": _ASOF,
    "asof_get_merged": _ASOF,
    "cf_list": _with(_ALL) + " select distinct cf from kv_all",
    "cf_stats": _with(_ALL, _newest("kv_all")) + " select cf, count(*) as n_keys from live group by cf",
    "cf_scan": _with(_ALL, _newest("kv_all")) + " select key, value from live where cf = 'orders' and starts_with(key, 'cust:00000')",
    "merge_runs": _E + " select key, value, commit_ts from live",
    "run_key_ranges": _with(_EVENTS) + " select commit_ts % 4 as run, count(*) as n_versions, min(key) as min_key, max(key) as max_key from kv_events group by 1",
    "file_pruning": _with(_FILES) + " select * from files where min_key <= '0000150' and '0000150' <= max_key",
    "last_commit_per_key": _with(_EVENTS) + " select key, max(commit_ts) as last_commit_ts from kv_events group by key",
    "batch_apply": _with(_EVENTS, _BATCH, "both_ as (select * from kv_events union all select cf, key, (select max(commit_ts) + 1 from kv_events), seq, op, value from batch)", _newest("both_"))
    + " select key, value, commit_ts from live",
    "cf_batch_apply": _with(
        _ALL, _BATCH, "both_ as (select * from kv_all union all select case when seq % 3 = 0 then 'orders' else 'default' end, key, (select max(commit_ts) + 1 from kv_all), seq, op, value from batch)", _newest("both_")
    )
    + " select cf, key, value, commit_ts from live",
    "txn_overlay_read": _with(_EVENTS, _WRITES)
    + """, r as (select event_id as txn_id, event_id + 2 - 40 as start_ts, concat('user:', user_id + i) as key from events, (select unnest([0, 1, 2]) as i) where event_id % 97 = 0),
      s as (select txn_id, r.key, case when op = 'PUT' and strlen(value) > 0 then value end as value from r asof left join kv_events v on r.key = v.key and r.start_ts >= v.commit_ts)
      select s.txn_id, s.key, case when w.op is not null then w.value else s.value end as value, case when w.op is not null then 'pending' when s.value is not null then 'snapshot' else 'none' end as source
      from s left join txn_writes w on w.txn_id = s.txn_id and w.key = s.key""",
    "txn_conflicts": _with(_EVENTS, _WRITES) + _CONFLICTS + " select * from c",
    "txn_clean": _with(_EVENTS, _WRITES) + _CONFLICTS + " select distinct txn_id from txn_writes where txn_id not in (select txn_id from c)",
    "compact_documented": _E + """ select key, commit_ts, op, value from ranked where op = 'PUT' and (rank = 1 or commit_ts <= (select max(commit_ts) // 2 from kv_events))""",
    "compact_safe": _with(_EVENTS, _newest("kv_events", "commit_ts <= (select max(commit_ts) // 2 from kv_events)"))
    + """ select key, commit_ts, 'PUT' as op, value from live union all
      select key, commit_ts, case when value <> '' then op else 'DELETE' end, nullif(value, '') from kv_events where commit_ts > (select max(commit_ts) // 2 from kv_events)""",
    "wal_replay": _with(
        _EVENTS,
        """placed as (select cf, key, op, value, commit_ts as seq, case when ((commit_ts - 2) // 10) % 3 = 0 then max(commit_ts) over (partition by (commit_ts - 2) // 10) else commit_ts end as commit_ts from kv_events)""",
        _newest("placed"),
    )
    + " select key, value, commit_ts from live",
    "manifest_levels": _with(_FILES) + " select * from files",
    "inspect_levels": _with(_FILES) + " select coalesce(cast(level as varchar), 'total') as level, count(*) as n_files, cast(sum(size) as bigint) as n_bytes from files group by rollup(files.level)",
    "oldest_snapshot": _with(_WRITES) + " select coalesce(min(start_ts), 0) as oldest from txn_writes",
    "value_checksums": _with(_EVENTS)
    + """, t as (select [list_reduce(list_prepend(cast(i as bigint), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) for i in range(256)] as crc),
      b as (select commit_ts, list_prepend(cast(4294967295 as bigint), [cast(ascii(value[i + 1]) as bigint) for i in range(len(value))]) as bytes from kv_events where value is not null)
      select commit_ts, case when len(bytes) = 1 then 0 else xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b) + 1])), 4294967295) end as crc32 from b, t""",
    "user_keys": "select c_custkey, concat('user:', lower(c_name)) as key, concat('user:', lower(c_name)) as path_key from customer",
    "value_separation": _with(_DOCS) + " select key, strlen(value) as n_bytes, case when strlen(value) > 64 then 'pointer' else 'inline' end as placement from kv_docs",
    "vlog_deref": _with(_VLOG) + """, p as (select case when doc_id % 7 = 0 then "offset" + 1 else "offset" end as "offset", size from vlog) select p."offset", p.size, v.doc_id from p left join vlog v on v."offset" = p."offset" and v.size = p.size""",
    "vlog_live": _with(_VLOG) + ' select doc_id, "offset", size from vlog where doc_id in (select doc_id from labels)',
    "vlog_garbage": _with(_VLOG) + ' select doc_id, "offset", size from vlog where doc_id not in (select doc_id from labels)',
    "vlog_relocate": _with(_VLOG)
    + """ select "offset" as old_offset, cast(8 + coalesce(sum(8 + size) over (order by "offset" rows between unbounded preceding and 1 preceding), 0) as bigint) as new_offset, size from vlog where doc_id in (select doc_id from labels)""",
    "users_from_kv": _with(_USERS) + " select * from users",
    "authz_matrix": _with(_USERS) + f" select username, method, {_ALLOWED} as allowed from users, (select unnest({METHODS}) as method)",
    "jwt_claims": _with(_USERS) + " select username as sub, roles, created_at + 86400 as exp, created_at as iat from users",
    "change_feed": _FEED,
    "rest_scan_json": _E + " select to_json(struct_pack(key := key, value := value)) as item from live where starts_with(key, 'user:1')",
    "export_tsv": _E + " select concat(key, chr(9), value) as line from live",
    "ts_invert": _with(_EVENTS) + " select key, 9223372036854775807 - commit_ts as inverted_ts from kv_events",
    "bloom_bits": _with(_EVENTS)
    + """, k as (select distinct key from kv_events),
      h as (select key, list_reduce(list_prepend(cast(2166136261 as bigint), [cast(ascii(c) as bigint) for c in string_split(key, '')]), lambda a, b: (xor(a, b) * 16777619) & 4294967295) as fnv1a32 from k)
      select key, fnv1a32, array_to_string([((fnv1a32 + i * xor(fnv1a32, cast(3164544308 as bigint))) & 4294967295) % 8192 for i in range(10)], ',') as bits from h""",
    "asof_get_cf": _with(_FAMILIES)
    + f""", r as (select event_id as req_id, {_CF.format("event_id")}, concat('user:', (user_id * 7) % 200) as key, event_id as snapshot_ts from events where event_id % 50 = 0)
      select req_id, r.cf, r.key, snapshot_ts, case when op = 'PUT' and strlen(value) > 0 then value end as value, commit_ts
      from r asof left join kv_families v on r.cf = v.cf and r.key = v.key and r.snapshot_ts >= v.commit_ts""",
    "txn_conflicts_cf": _with(_FAMILIES, _WRITES, f"w as (select *, {_CF.format('txn_id')} from txn_writes)")
    + """ select txn_id, w.cf, w.key, max(commit_ts) as commit_ts from w join kv_families v on v.cf = w.cf and v.key = w.key and v.commit_ts > w.start_ts and v.commit_ts < w.txn_id + 2 group by all""",
    "txn_overlay_cf": _with(_FAMILIES, _WRITES, f"w as (select *, {_CF.format('txn_id')} from txn_writes)")
    + f""", r as (select event_id as txn_id, {_CF.format("event_id")}, event_id + 2 - 40 as start_ts, concat('user:', user_id + i) as key from events, (select unnest([0, 1, 2]) as i) where event_id % 97 = 0),
      s as (select txn_id, r.cf, r.key, case when op = 'PUT' and strlen(value) > 0 then value end as value from r asof left join kv_families v on r.cf = v.cf and r.key = v.key and r.start_ts >= v.commit_ts)
      select s.txn_id, s.cf, s.key, case when w.op is not null then w.value else s.value end as value, case when w.op is not null then 'pending' when s.value is not null then 'snapshot' else 'none' end as source
      from s left join w on w.txn_id = s.txn_id and w.cf = s.cf and w.key = s.key""",
    "version_rank": _with(_FAMILIES) + " select cf, key, commit_ts, row_number() over (partition by cf, key order by commit_ts desc, seq desc) - 1 as rank from kv_families",
    "recent_ops": _with(_EVENTS) + " select key, commit_ts, op from kv_events order by commit_ts desc limit 100",
    "level_order": _with(_FILES) + " select level, file_num, row_number() over (partition by level order by min_key, file_num) - 1 as place from files",
    "role_lists": """with r as (select c_custkey, ['admin', lower(c_mktsegment), 'readonly'] || case when c_custkey % 2 = 0 then ['readwrite'] else [] end as roles from customer)
      select c_custkey, array_to_string(roles, '|') as roles, array_to_string(list_filter(roles, lambda x: x in ('admin', 'readwrite', 'readonly')), '|') as valid, c_custkey % 2 = 0 as has_both from r""",
    "path_rules": """select c_custkey, verb, case c_custkey % 4 when 2 then '' when 3 then 'admin' else
        case when verb = 'GET' or verb = 'POST' and c_custkey % 4 = 0 then 'readonly,readwrite,admin' when verb = 'PATCH' then 'admin' else 'readwrite,admin' end end as roles
      from customer, (select unnest(['GET', 'PUT', 'POST', 'DELETE', 'PATCH']) as verb)""",
    "error_codes": "select c_custkey, case c_custkey % 3 when 0 then 'UNAUTHORIZED' when 1 then 'FORBIDDEN' else 'AUTH_ERROR' end as code from customer",
    "droppable_families": "select unnest(['default', 'orders', 'docs', '__auth__']) as cf, unnest([true, true, true, false]) as droppable",
    "scan_total": _E + " select count(*) as total from live where starts_with(key, 'user:1')",
    "rest_scan_body": _E
    + """, p as (select key, value, (row_number() over (order by key) - 1) // 20 as page from live where starts_with(key, 'user:1'))
      select page, cast(to_json(struct_pack(cf := 'default', prefix := 'user:1', items := list(struct_pack(key := key, value := value) order by key))) as varchar) as body from p group by page""",
    "change_feed_source": _FEED.replace(", commit_ts from kv_events", ", commit_ts, case commit_ts % 10 when 3 then 'batch' when 7 then 'transaction' else 'put' end as source from kv_events"),
    "filter_membership": _with(_EVENTS, _BITS)
    + """, f as (select run, list_distinct(flatten(list(bits))) as all_bits from (select distinct commit_ts % 64 as run, key from kv_events where commit_ts % 64 < 8) join bits using (key) group by run)
      select run, key, list_has_all(all_bits, bits) as may_contain from bits, f""",
    "native_store": _with(f"{_FAMILIES}, {_DOCS}, both_ as (select * from kv_families union all select * from kv_docs)", _newest("both_")) + " select cf, key, value, commit_ts from live",
    "native_history": _with(_EVENTS) + " select cf, key, commit_ts, case when op = 'PUT' and strlen(value) > 0 then 'PUT' else 'DELETE' end as op, nullif(value, '') as value from kv_events",
    "native_tables": _with(_EVENTS) + " select count(*) as n_entries, min(key) as min_key, max(key) as max_key, true as agree from kv_events where commit_ts <= (select max(commit_ts) // 2 from kv_events)",
    "store_commits": """select 'nations' as cf, n_name as key, case n_name when 'NATION_3' then 'b' when 'NATION_5' then 'txn' else cast(n_nationkey as varchar) end as value,
        cast(case n_name when 'NATION_3' then 6 when 'NATION_5' then 7 else 2 end as bigint) as commit_ts from nation where n_name <> 'NATION_4'
      union all select 'default', r_name, case when r_name = 'EUROPE' then 'here' when r_regionkey % 2 = 0 then 'second' else 'first' end,
        cast(case when r_name = 'EUROPE' then 6 when r_regionkey % 2 = 0 then 4 else 2 end as bigint) from region where r_name <> 'ASIA'""",
    "user_accounts": """select lower(r_name) as username, case when r_name = 'ASIA' then 'readwrite' when r_regionkey = 0 then 'admin' when r_regionkey = 1 then 'readonly' else 'readonly,readwrite' end as roles
      from region where r_name <> 'EUROPE'""",
    "change_feed_stream": _FEED,
    "latest_view_stream": _INFO,
}
