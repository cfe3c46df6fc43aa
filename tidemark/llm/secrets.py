"""Secret scans: fixed rules, and two character Markov models, in DataFrame and SQL functions only.

The rules find assignments to secret names, access keys and long hex runs. The
models tell random strings from ordinary identifiers: each gives the chance of
a character after another; a run of at least 16 characters with a letter whose
log-likelihood ratio passes a threshold is added as kind `markov`. What the
rules' spans leave of a run is judged piece by piece, each of 16 characters or
more. Plain numbers aren't judged. Both models are counted from labelled samples:
random are the values that the rules find and encodings of hashes, ordinary are
the words of a sample of documents outside the rules' spans.

A null text counts as empty and has no spans. Repeated rows are scanned each.
Places are code points, end exclusive. A row is scanned by itself, without a
shuffle, and whole: time grows with the text and with n log n of its n spans,
as places are running totals by doubling, and a text is cut by pieces of `CHUNK`
characters, never counted through from its start for each span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = "[A-Za-z0-9+/_=-]"
#: Shortest run that the models judge.
MIN_RUN = 16
CANDIDATE = rf"(?<!{_RUN}){_RUN}{{{MIN_RUN},}}+"
#: Least log-likelihood ratio of a run: odds of about one in 160,000 runs being random.
MIN_RATIO = 12.0
#: Ratios are whole numbers of this part, so that their sums don't depend on an order.
SCALE = 10_000
#: Share of even chance mixed into both models, so that pairs that neither has met tell nothing.
FLOOR = 0.02
#: Documents whose words are the sample of ordinary identifiers, and hashes encoded as random strings.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 4000
#: Characters of a piece of a text that is cut at spans.
CHUNK = 4096


def _sql(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, op: str) -> str:
    """The running totals of an array by doubling: in each step every element takes in the one 1, 2, 4, ... before it."""
    step = "cast(shiftleft(1, k) as int)"
    return f"""if(size({values}) < 2, {values}, aggregate(sequence(0, cast(ceil(log2(size({values}))) as int) - 1), {values},
        (acc, k) -> zip_with(acc, concat(array_repeat(cast(0 as int), least(size(acc), {step})), slice(acc, 1, greatest(0, size(acc) - {step}))), (a, b) -> {op})))"""


def _matches(df: DataFrame, text: str, name: str, pattern: str, given: str = "true") -> DataFrame:
    """Adds `name`, the matches of a pattern, and `name`_ends, where each ends: the running totals of the matches' lengths and of what lies before."""
    p = _sql(pattern)
    df = df.withColumn(name, F.expr(f"if({given}, regexp_extract_all({text}, {p}, 0), cast(array() as array<string>))"))
    df = df.withColumn(f"{name}_ends", F.expr(f"if(size({name}) = 0, cast(array() as array<int>), zip_with(slice(split({text}, {p}, -1), 1, size({name})), {name}, (a, b) -> length(a) + length(b)))"))
    return df.withColumn(f"{name}_ends", F.expr(_running(f"{name}_ends", "a + b")))


def _spans(name: str, kind: int) -> str:
    return f"zip_with({name}, {name}_ends, (m, e) -> struct(e - length(m) as begin, {kind} as kind, e as end))"


def rule_spans(docs: DataFrame) -> DataFrame:
    """From column t: column `base`, the spans of the three rules by begin, then kind. Texts without a secret's name skip that rule."""
    named = " or ".join(f"contains(low, '{w}')" for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    df = _matches(docs.withColumn("low", F.lower("t")), "t", "m1", ASSIGN, named)
    df = _matches(_matches(df, "t", "m2", ACCESS, "contains(t, 'AKIA')"), "t", "m3", HEX)
    values = f"if(size(m1) = 0, m1, regexp_extract_all(t, {_sql(ASSIGN)}, 1))"
    assigns = f"transform(filter(zip_with({_spans('m1', 1)}, {values}, (s, v) -> struct(s, v)), x -> length(x.v) >= 8), x -> x.s)"
    df = df.withColumn("base", F.expr(f"sort_array(concat({assigns}, {_spans('m2', 2)}, {_spans('m3', 3)}))"))
    return df.drop("low", *(f"m{k}{end}" for k in (1, 2, 3) for end in ("", "_ends")))


def _replaced(df: DataFrame, text: str, spans: str, name: str, filler: str) -> DataFrame:
    """Adds `name`, the text with each run of overlapping spans (sorted) replaced by `filler`, which may ask for x.b and x.e."""
    top = df.withColumn("_top", F.expr(_running(f"transform({spans}, s -> s.end)", "greatest(a, b)")))  # the furthest end so far
    begins = f"filter(zip_with({spans}, concat(array(-1), slice(_top, 1, size(_top) - 1)), (s, p) -> struct(s.begin as b, p)), x -> x.b >= x.p)"
    ends = f"filter(zip_with(_top, slice(transform({spans}, s -> s.begin), 2, size(_top) - 1), (t, n) -> struct(t, n)), x -> x.n is null or x.n >= x.t)"
    runs = top.withColumn("_runs", F.expr(f"if(size({spans}) = 0, null, zip_with({begins}, {ends}, (x, y) -> struct(x.b as b, y.t as e)))"))
    runs = runs.withColumn("_chunks", F.expr(f"if(_runs is null, null, regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0))"))
    piece = lambda b, e: f"""if({e} <= {b}, '', substring(array_join(slice(_chunks, cast({b} div {CHUNK} as int) + 1, cast(({e} - 1) div {CHUNK} as int) - cast({b} div {CHUNK} as int) + 1), ''),
        {b} % {CHUNK} + 1, {e} - {b}))"""  # noqa: E731
    gaps = "zip_with(_runs, concat(array(0), transform(slice(_runs, 1, size(_runs) - 1), x -> x.e)), (x, p) -> struct(x.b as b, x.e as e, p as p))"
    done = f"concat(array_join(transform({gaps}, x -> concat({piece('x.p', 'x.b')}, {filler})), ''), {piece('element_at(_runs, -1).e', f'length({text})')})"
    return runs.withColumn(name, F.expr(f"if(_runs is null, {text}, {done})")).drop("_top", "_runs", "_chunks")


def _codes(word: str) -> str:
    """The places in LETTERS of a word's characters, from 0."""
    places = ",".join(str(max(0, LETTERS.find(chr(c)))) for c in range(128))
    return f"transform(split({word}, ''), c -> element_at(cast(split('{places}', ',') as array<int>), ascii(c) + 1))"


def _pairs(words: DataFrame) -> DataFrame:
    """Counts of adjacent characters of the words of each label."""
    coded = words.where("length(w) > 1").select("label", F.expr(_codes("w")).alias("c"))
    pairs = f"zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> a * {len(LETTERS)} + b)"
    return coded.select("label", F.expr(f"explode({pairs})").alias("pair")).groupBy("label", "pair").count()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Log-likelihood ratios of all pairs of characters, random over ordinary (67 x 67 numbers, in parts of `SCALE`).

    The sample: of the `SAMPLE_DOCS` ids whose md5 is lowest, the rules'
    values (random) and all other words of 6 characters or more (ordinary), and
    `SAMPLE_RANDOM` hashes in base 64 and in hex (random).
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct().orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(SAMPLE_DOCS)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).join(F.broadcast(ids), "id")
    rules = [_sql(p) for p in (ASSIGN, ACCESS, HEX)]
    values = texts.select(F.expr(f"explode(concat(regexp_extract_all(t, {rules[0]}, 1), regexp_extract_all(t, {rules[1]}, 0), regexp_extract_all(t, {rules[2]}, 0)))").alias("v"))
    values = values.where("length(v) >= 16").select(F.lit(1).alias("label"), F.expr(f"explode(regexp_extract_all(v, {_sql(_RUN + '+')}, 0))").alias("w"))
    without = F.col("t")
    for p in (ASSIGN, ACCESS, HEX):
        without = F.regexp_replace(without, F.lit(p), F.lit(" "))
    words = texts.select(without.alias("t")).select(F.lit(0).alias("label"), F.expr(f"explode(regexp_extract_all(t, {_sql(_RUN + '{6,}')}, 0))").alias("w"))
    made = spark.range(SAMPLE_RANDOM).select(F.expr("sha2(cast(id as string), 256)").alias("h"), "id")
    made = made.select(F.lit(1).alias("label"), F.expr("if(id % 4 = 0, substring(h, 1, 40), translate(base64(unhex(h)), '+/=', if(id % 4 = 1, '+/=', '')))").alias("w"))
    counts = {(r.label, r.pair): r["count"] for r in _pairs(values.unionByName(words).unionByName(made)).collect()}  # at most 2 x 67 x 67 rows
    n = len(LETTERS)
    out = []
    for a in range(n):
        rows = [[counts.get((label, a * n + b), 0) for b in range(n)] for label in (0, 1)]
        chance = [[(1 - FLOOR) * c / max(1, sum(row)) + FLOOR / n for c in row] for row in rows]
        out += [math.floor(math.log(r / o) * SCALE + 0.5) for o, r in zip(*chance)]
    return out


def ratio(word: str, ratios: list[int]) -> str:
    """A word's log-likelihood ratio: the sum over its pairs of characters; the word is taken apart once."""
    table = f"cast(split({_sql(','.join(map(str, ratios)))}, ',') as array<int>)"
    pairs = f"zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> element_at({table}, a * {len(LETTERS)} + b + 1))"
    return f"element_at(transform(array({_codes(word)}), c -> aggregate({pairs}, 0L, (s, r) -> s + r)), 1)"


def scan(docs: DataFrame, ratios: list[int], text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("base", "found")) -> DataFrame:
    """Appends two columns, by default `base` and `found`: the rules' spans, and all spans, as arrays of (begin, kind, end).

    Kinds are numbered from 1 in the order of `KINDS`. Columns that docs has
    under these names give way. Runs are looked for where the rules' spans are
    blanked out, so that what they leave of a run is a run of its own.
    """
    stay = [c for c in (docs.columns if keep is None else keep) if c not in names]
    own = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in stay)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    blanked = _replaced(rule_spans(own), "t", "base", "rest", "repeat(' ', x.e - x.b)")
    df = _matches(blanked, "rest", "m4", CANDIDATE)
    runs = f"zip_with({_spans('m4', 4)}, m4, (s, v) -> struct(s, v))"
    judged = f"x.v rlike '[A-Za-z]' and {ratio('x.v', ratios)} > {round(MIN_RATIO * SCALE)}"
    df = df.withColumn("found", F.expr(f"if(size(m4) = 0, base, sort_array(concat(base, transform(filter({runs}, x -> {judged}), x -> x.s))))"))
    return df.select(*(F.col(f"row.`{c}`") for c in stay), _whole(F.col("base")).alias(names[0]), _whole(F.col("found")).alias(names[1]))


def _whole(column: Column) -> Column:
    """The column, beyond which no filter is pushed: it would repeat every step before, some within others."""
    return F.when(F.spark_partition_id() >= 0, column)


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind), ':', s.begin, ':', s.end)), ',')"


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by rule, the digest of the rules' spans, and all spans as text."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3], 1)]
    return scanned.select("doc_id", *counts, F.expr(f"sha2({_joined('base')}, 256)").alias("base_sha256"), F.expr(_joined("found")).alias("spans"))


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]", names: tuple[str, str] = ("base", "found")) -> DataFrame:
    """Each run of overlapping spans of the text replaced by a mark; texts without spans stay as they are. Drops the columns of spans."""
    stay = [c for c in scanned.columns if c not in names]
    own = scanned.select(F.struct(*(F.col(f"`{c}`") for c in stay)).alias("row"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{names[1]}`").alias("spans"))
    done = _replaced(own, "t", "spans", "clean", _sql(mark))
    return done.select(*(_whole(F.col("clean")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in stay))
