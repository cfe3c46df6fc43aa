"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, dedup, langid, quality, secrets, sharding, tokencount, toxicity, warc
from tidemark.llm.common import small_batches, table
from tidemark.llm.samples import fold


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Queries own their session: they bound its Arrow batches."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str, *args, **kwargs) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir, *args, **kwargs)

    return run


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def _held_out(folds: int, which: int):
    return F.coalesce(fold("doc_id", folds) == which, F.lit(False)).alias("held_out")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs), keep=["doc_id"])
    bits = F.expr("array_join(transform(map_entries(bits), e -> concat(e.key, ':', cast(round(e.value, 3) as string))), ',')").alias("code_bits")
    return found.select("doc_id", _held_out(langid.FOLDS, langid.HELD_OUT), "lang_pred", "score", bits)


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica with known damage: bodies turned by a character or grown, records lost, and records that don't belong there."""
    pages = table(spark, sf_dir, "pages")
    page, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    turned, grown, lost = page % 97 == 3, page % 103 == 5, F.coalesce(page % 101 == 7, F.lit(False))
    stored = F.when(turned, F.expr("concat(substring(coalesce(html, ''), 2), left(coalesce(html, ''), 1))")).when(grown, F.concat(body, F.lit("more"))).otherwise(body)
    hashed = lambda text: [page.alias("id"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("digest")]
    extra = pages.where((page % 89 == 1) & ~turned & ~grown & ~lost).select(*hashed(warc.record(page, F.lit("http://elsewhere/"), F.lit("not of this archive"))))
    first = warc.index(pages.select(*hashed(warc.record(page, F.col("url"), body))), "first")
    second = warc.index(pages.where(~lost).select(*hashed(warc.record(page, F.col("url"), body, stored))).unionByName(extra), "second")
    return warc.audit(first, second).select(F.col("id").alias("page_id"), "file", "offset", F.col("size").alias("length"), "problem")


def _op5_sql() -> str:
    record = lambda url, body, stored: f"""concat('WARC/1.1\\r\\nWARC-Type: resource\\r\\nWARC-Record-ID: <urn:md5:', md5(concat(page_id, ' ', {url}, ' ', {body})), '>\\r\\nWARC-Date: {warc.DATE}\\r\\nWARC-Target-URI: ',
      replace(replace({url}, chr(13), '%0D'), chr(10), '%0A'), '\\r\\nContent-Type: text/html\\r\\nContent-Length: ', strlen({body}), '\\r\\n\\r\\n', {stored}, '\\r\\n\\r\\n')""".replace("'WARC", "e'WARC").replace("'>\\", "e'>\\").replace("'\\", "e'\\")  # noqa: E731
    turned = "case when page_id % 97 = 3 then concat(substring(body, 2), left(body, 1)) when page_id % 103 = 5 then concat(body, 'more') else body end"
    placed = lambda rows: f"""select *, strlen(rec) as length, cast(sum(strlen(rec)) over (partition by file order by page_id, sha256(rec) rows unbounded preceding) - strlen(rec) as bigint) as "offset" from ({rows})"""
    return f"""
with r as (select page_id, page_id // {warc.FILE_IDS} as file, coalesce(url, '') as url, coalesce(html, '') as body from pages),
a as ({placed(f"select page_id, file, {record('url', 'body', 'body')} as rec, {turned} <> body as damaged from r")}),
b as ({placed(f"select page_id, file, {record('url', 'body', turned)} as rec, false as foreign_ from r where page_id % 101 <> 7 union all select page_id, file, {record(repr('http://elsewhere/'), repr('not of this archive'), repr('not of this archive'))}, true from r where page_id % 89 = 1 and page_id % 97 <> 3 and page_id % 103 <> 5 and page_id % 101 <> 7")})
select page_id, file, "offset", length, case when page_id % 101 = 7 then 'missing' else 'changed' end as problem from a where page_id % 101 = 7 or damaged
union all select page_id, file, "offset", length, 'extra' from b where foreign_
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], real=False)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    sentences = F.expr("array_join(transform(sentences, s -> concat(s.begin, ':', s.end, ':', cast(round(s.score, 4) as string))), ',')").alias("sentences")
    return found.select("doc_id", _held_out(toxicity.FOLDS, 0), "score", "predicted", sentences)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    pieces = tokencount.public_vocabulary(vocabulary or tokenizer_path("piece_bpe_32k.model"))
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), pieces, keep=["doc_id"])


@query
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs), keep=["doc_id"]))


@query
def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary or tokenizer_path("word_bpe_49k.json"), keep=["doc_id"], real=False)


_BLANKS = r"[\x20\x09-\x0D]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) = 1 then [words[1]]
    else list_transform(range(1, len(words)), lambda i: concat(words[i], ' ', words[i + 1])) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
classes as (select h, min(doc_id) as doc_id from (select doc_id, md5(string_agg(shingle, chr(10) order by shingle)) as h from s group by doc_id) group by h),
member as (select x.doc_id, c.doc_id as class from (select doc_id, md5(string_agg(shingle, chr(10) order by shingle)) as h from s group by doc_id) x join classes c using (h)),
r as (select s.doc_id, s.shingle, n.n from s join classes using (doc_id) join n using (doc_id)),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both_, any_value(a.n) as na, any_value(b.n) as nb
  from r a join r b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from pairs where 100 * both_ >= 80 * (na + nb - both_)),
edges as (select a, b from links union select b, a from links),
reach(id, node) as (select a, a from edges union select r.id, e.b from reach r join edges e on e.a = r.node),
root as (select id, min(node) as root from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(root.root, member.class, d.doc_id) as component_id, coalesce(root.root, member.class, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join member using (doc_id) left join root on root.id = member.class
"""

_OP2_CHARS = ", ".join(f"coalesce(max(c.chars) filter (c.n = {n}), 0) as dup_chars_{n}" for n in quality.NGRAM_LIMITS)
_OP2_FINE = " and ".join(f"dup_chars_{n} <= {limit} * word_chars" for n, limit in quality.NGRAM_LIMITS.items())
OP2_SQL = rf"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
b as (select doc_id, words, len(words) as n_words, length(regexp_replace(text, '{_BLANKS}', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
l as (select doc_id, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(list_sum(list_transform(lines, lambda x: length(regexp_replace(x, '{_BLANKS}', '', 'g')))), 0) - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(regexp_replace(x, '{_BLANKS}', '', 'g')))), 0) as dup_line_chars from b),
g as (select doc_id, n, i, hash(array_to_string(words[i:i + n - 1], ' ')) as gram from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from b, (select unnest({list(quality.NGRAM_LIMITS)}) as n))),
d as (select doc_id, n, i from g qualify count(*) over (partition by doc_id, n, gram) > 1),
p as (select distinct doc_id, n, unnest(range(i, i + n)) as pos from d),
c as (select p.doc_id, p.n, count(*) as words, sum(length(b.words[p.pos])) as chars from p join b using (doc_id) group by 1, 2),
m as (select b.doc_id, b.n_words, b.word_chars, b.n_symbols, l.n_dup_lines, coalesce(max(c.words) filter (c.n = 5), 0) as n_repeat_words, cast(l.dup_line_chars as bigint) as dup_line_chars, {_OP2_CHARS}
  from b join l using (doc_id) left join c on c.doc_id = b.doc_id group by all),
f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed, dup_line_chars, {", ".join(f"cast(dup_chars_{n} as bigint) as dup_chars_{n}" for n in quality.NGRAM_LIMITS)},
  not base_failed and dup_line_chars <= {quality.LINE_LIMIT} * word_chars and {_OP2_FINE} as kept from f
"""

OP4_SQL = f"""
with t as (select [list_reduce(list_prepend(cast(i as bigint), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) for i in range(256)] as crc),
s as (select doc_id, cast(strlen(coalesce(text, '')) + {sharding.ROW_OVERHEAD} as bigint) as size, hex(coalesce(text, '')) as bytes from documents),
x as (select doc_id, size, xor(list_reduce(list_prepend(cast(4294967295 as bigint), [cast(concat('0x', b) as bigint) for b in regexp_extract_all(bytes, '..')]),
    lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b) + 1])), 4294967295) as text_crc32 from s, t),
p as (select *, sum(size) over (order by doc_id, text_crc32, size rows unbounded preceding) - size as before, sum(size) over () as total from x),
c as (select *, cast(least({sharding.N_SHARDS - 1}, ((2 * before + size) * {sharding.N_SHARDS}) // (2 * total)) as integer) as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, cast(null as integer) as grown_shard from c
"""

OP6_SQL = rf"""
with dw as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
iw as (select row_number() over () as tx, cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark where item_id is not null),
win as (select tx, item, j, size, array_to_string(words[j:j + size - 1], ' ') as gram from
  (select tx, item, words, least({decontam.WINDOW}, len(words)) as size, unnest(range(1, len(words) - least({decontam.WINDOW}, len(words)) + 2)) as j from iw where len(words) > 0)),
grams as (select doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') as gram from
  (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i from dw, (select distinct size from win))),
hits as (select doc_id, g.size, i, j, tx, item from grams g join win using (size, gram)),
hit as (select distinct doc_id, pos from (select doc_id, unnest(range(i, i + size)) as pos from hits)),
islands as (select doc_id, min(pos) - 1 as b, max(pos) as e from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as island from hit) group by doc_id, island),
places as (select doc_id, cast(sum(e - b) as bigint) as n_hit, string_agg(concat(b, ':', e), ',' order by b) as spans from islands group by doc_id),
lines as (select doc_id, size, tx, i - j as line, i - row_number() over (partition by doc_id, size, tx, i - j order by i) as island from hits),
longest as (select doc_id, max(n + size - 1) as longest from (select doc_id, size, count(*) as n from lines group by doc_id, size, tx, line, island) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= {decontam.MIN_ITEMS} as contaminated,
  coalesce(spans, '') as spans, coalesce(longest, 0) as longest
from dw d left join places using (doc_id) left join longest using (doc_id) left join items using (doc_id)
"""


def _op9_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    any_case = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")  # without Unicode's folding
    assign, access, hexes, letters, run, n = (
        quoted(secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{any_case})")), quoted(secrets.ACCESS), quoted(secrets.HEX), quoted(secrets.LETTERS), "[A-Za-z0-9+/_=-]", len(secrets.LETTERS)
    )
    matched = lambda k, p, v: f"select row, {k} as kind, unnest(string_split_regex(t, {p})) as gap, unnest(regexp_extract_all(t, {p}, 0)) as m, unnest({v}) as v, generate_subscripts(string_split_regex(t, {p}), 1) as i from d"
    return rf"""
with ids as (select doc_id from (select distinct doc_id from documents where doc_id is not null) order by md5(cast(doc_id as varchar)), doc_id limit {secrets.SAMPLE_DOCS}),
texts as (select coalesce(text, '') as t from documents join ids using (doc_id)),
secret as (select unnest(list_concat(regexp_extract_all(t, {assign}, 1), list_concat(regexp_extract_all(t, {access}, 0), regexp_extract_all(t, {hexes}, 0)))) as v from texts),
hashes as (select i, sha256(cast(i as varchar)) as h from range({secrets.SAMPLE_RANDOM}) as r(i)),
words as (select 1 as label, unnest(regexp_extract_all(v, '{run}+', 0)) as w from secret where length(v) >= 16
  union all select 0, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, {assign}, ' ', 'g'), {access}, ' ', 'g'), {hexes}, ' ', 'g'), '{run}{{6,}}', 0)) from texts
  union all select 1, case when i % 4 = 0 then substr(h, 1, 40) when i % 4 = 1 then to_base64(unhex(h)) else translate(to_base64(unhex(h)), '+/=', '') end from hashes),
pairs as (select label, instr({letters}, w[i]) - 1 as a, instr({letters}, w[i + 1]) - 1 as b, count(*) as n from (select label, w, unnest(range(1, length(w))) as i from words) group by all),
grid as (select label, a, b, coalesce(pairs.n, 0) as n, greatest(1, sum(coalesce(pairs.n, 0)) over (partition by label, a)) as total
  from (select label, a, b from (select unnest([0, 1]) as label) l, (select unnest(range({n})) as a) x, (select unnest(range({n})) as b) y) g left join pairs using (label, a, b)),
chance as (select label, a, b, {1 - secrets.FLOOR}::double * n / cast(total as double) + {secrets.FLOOR}::double / {n} as p from grid),
ratios as (select o.a, o.b, cast(floor(ln(r.p / o.p) * {secrets.SCALE} + 0.5::double) as bigint) as r from chance o join chance r using (a, b) where o.label = 0 and r.label = 1),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
m as ({matched(1, assign, f"regexp_extract_all(t, {assign}, 1)")} union all {matched(2, access, "[]::varchar[]")} union all {matched(3, hexes, "[]::varchar[]")} union all {matched(4, quoted(run + "{16,}"), "[]::varchar[]")}),
s as (select row, kind, m, v, sum(length(gap) + coalesce(length(m), 0)) over (partition by row, kind order by i) as e from m),
spans as (select row, kind, e - length(m) as b, e, m from s where m is not null and (kind <> 1 or length(v) >= 8)),
base as (select row, kind, b, e from spans where kind < 4),
taken as (select distinct row, unnest(range(cast(b as bigint), cast(e as bigint))) as pos from base),
chars as (select row, cast(b as bigint) + i - 1 as pos, instr({letters}, m[i]) - 1 as code from (select row, b, m, unnest(range(1, length(m) + 1)) as i from spans where kind = 4)),
left_ as (select row, pos, code, pos - row_number() over (partition by row order by pos) as island from chars anti join taken using (row, pos)),
steps as (select row, island, pos, code, lead(code) over (partition by row, island order by pos) as after from left_),
judged as (select row, island, min(pos) as b, max(pos) + 1 as e, bool_or(code < 52) as letter, coalesce(sum(r), 0) as r from steps left join ratios on a = code and ratios.b = after group by row, island),
found as (select * from base union all select row, 4, b, e from judged where e - b >= {secrets.MIN_RUN} and letter and r > {round(secrets.MIN_RATIO * secrets.SCALE)}),
named as (select row, kind, concat({list(secrets.KINDS)}[kind], ':', cast(b as bigint), ':', cast(e as bigint)) as name, b, e from found),
g as (select row, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, count(*) filter (kind = 3) as n3, string_agg(name, ',' order by b, kind, e) filter (kind < 4) as base, string_agg(name, ',' order by b, kind, e) as spans from named group by row)
select doc_id, coalesce(n1, 0) as n_assign, coalesce(n2, 0) as n_access, coalesce(n3, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (row)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scans": op9_secret_scans,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op4_sharding": OP4_SQL,
    "op5_warc_fixity": _op5_sql(),
    "op6_decontamination": OP6_SQL,
    "op9_secret_scans": _op9_sql(),
}
