import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import decontam
from tidemark.llm.common import table

AT = "/root/testdata/sf0.001"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    own, hit, found, longest = words(text), set(), set(), 0
    for item, t in items:
        w = words(t)
        if item is None:
            continue
        for i in range(len(own)):
            for j in range(len(w)):
                k = 0
                while i + k < len(own) and j + k < len(w) and own[i + k] == w[j + k]:
                    k += 1
                if k >= min(window, len(w)):
                    longest = max(longest, k)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    names = sorted(found)
    edges = [i for i in sorted(hit) if i - 1 not in hit], [i + 1 for i in sorted(hit) if i + 1 not in hit]
    spans = ",".join(f"{b}:{e}" for b, e in zip(*edges))
    return [len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2, spans, longest], sorted(hit)


def run(texts, items, window=8):
    return [list(r) for r in zip(*decontam.make_kernel(False, window, 1, 0.5)(items)(texts))]


ITEM = "One two THREE four five six seven eight nine ten"
ITEMS = [("1", ITEM), ("10", "zero " + ITEM.lower()), ("2", "Short one"), ("3", None), ("4", " .. "), ("5", "a a a a a a a a a a")]
TEXTS = [None, "", "...", ITEM, "x one two three four five six seven eight y", "one two three four five six seven", "short, one!", "A " * 30, "a " * 7, f"zero-{ITEM} short onE {ITEM}", "éa short\tone"]


def test_odd_texts_equal_brute_force():
    assert run(TEXTS, ITEMS) == [brute(t, ITEMS, 8)[0] for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abC ", max_size=14), max_size=5), st.lists(st.text(alphabet="abc ", max_size=40), min_size=1, max_size=3), st.integers(1, 4))
def test_dense_texts_equal_brute_force(items, texts, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    assert run(texts, named, window) == [brute(t, named, window)[0] for t in texts]


def test_cut_text_has_no_windows_left_out_of_place():
    text = f"Keep this. {ITEM}! And that."
    spans, _, longest = decontam.Automaton(ITEMS).search(decontam.words_of(text))
    assert decontam.cut(text, spans, 1) == "Keep this. ! And that." and longest == 10


def test_frame_in_blocks_equals_one_block(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, ITEM, "clash")] * 2, "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id string, text string")
    whole = decontam.decontaminate(docs, items, keep=["doc_id"]).collect()
    parts = decontam.decontaminate(docs, items, keep=["doc_id"], block_bytes=60).collect()
    assert {str(r.asDict() | {"longest": 0}) for r in whole} == {str(r.asDict() | {"longest": 0}) for r in parts} and len(whole) == len(TEXTS) + 2
    assert [list(r)[1:8] for r in whole[: len(TEXTS)]] == [brute(t, ITEMS, 8)[0] for t in TEXTS]
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).where("n_items > 0").count() == 0


def test_passages_that_arise_at_seams_are_cut(spark):
    a, b = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(10)]
    items = spark.createDataFrame([("A", " ".join(a)), ("B", " ".join(b))], "item_id string, text string")
    nested, rest = " ".join([*b[:5], *a, *b[5:]]), " ".join(f"c{i}" for i in range(30))
    docs = spark.createDataFrame([(1, nested), (2, f"{nested} {rest}"), (3, rest), (4, None)], "doc_id long, text string")
    for block_bytes in (decontam.BLOCK_BYTES, 20):
        got = {r.doc_id: r for r in decontam.decontaminate(docs, items, block_bytes=block_bytes).collect()}
        assert (got[1].n_hit, got[1].n_items, got[1].stays) == (8, 1, False)
        assert (got[2].n_hit, got[2].stays, got[2].clean_text.split()) == (8, True, rest.split())
        assert got[3].clean_text == rest and got[4].clean_text is None and got[3].stays and got[4].stays


def test_pieces_hold_all_windows_of_a_large_item():
    text = " ".join(f"w{i % 97}" for i in range(1000))
    for limit in (1, 40, 500, 100_000):
        cut = decontam.pieces(text, 8, limit)
        assert max(map(len, cut)) <= max(limit, 8 * 4)
        whole = words(text)
        assert {tuple(whole[i : i + 8]) for i in range(993)} == {tuple(p.split()[i : i + 8]) for p in cut for i in range(len(p.split()) - 7)}
    assert decontam.pieces(None, 8, 10) == decontam.pieces("..", 8, 10) == [] and decontam.pieces("One two", 8, 1) == ["one two"]


def test_forced_blocks_equal_one_block_on_a_table(spark):
    """Whole table, items in many blocks, one item larger than any block, columns of the caller with the names inside."""
    docs = table(spark, AT, "documents").withColumn("_number", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("_spans", F.lit("x"))
    big = " ".join(r.text for r in docs.where("text is not null").orderBy("doc_id").limit(6).collect())
    items = table(spark, AT, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(-1, big)], "item_id long, text string"), allowMissingColumns=True)
    whole = decontam.decontaminate(docs, items)
    parts = decontam.decontaminate(docs, items, block_bytes=6000)
    assert parts.columns == whole.columns
    unlike = ("longest",)  # told up to a piece's length
    assert {str(r.asDict() | dict.fromkeys(unlike)) for r in whole.collect()} == {str(r.asDict() | dict.fromkeys(unlike)) for r in parts.collect()}
    assert decontam.Items(items.select(F.col("item_id").cast("string").alias("item"), "text"), 8, 6000).n > 4


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(1_200_000))
    docs = spark.createDataFrame([(1, f"{long} {ITEM}"), (2, "x" * 10_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([("1", ITEM), ("2", long)], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, items.where("item_id = 1"), keep=["doc_id"]).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].clean_text.strip()) == (1_200_010, 10, long) and got[2].n_words == 1
    got = {r.doc_id: r for r in decontam.decontaminate(docs, items, keep=["doc_id"], real=False).collect()}  # one item of 9 MB: several blocks
    assert (got[1].n_hit, got[1].n_items, got[1].spans) == (1_200_010, 2, "0:1200010") and got[2].n_hit == 0
