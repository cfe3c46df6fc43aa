import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hit = {}
    for n in quality.NGRAM_LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        hit[n] = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)}
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, own))
            seen.add(line)
    total = sum(map(len, words))
    failed = len(words) < 10 or 100 * len(hit[5]) > 20 * len(words)
    cover = {n: sum(len(words[i]) for i in h) for n, h in hit.items()}
    fine = dup_chars <= quality.LINE_LIMIT * total and all(cover[n] <= limit * total for n, limit in quality.NGRAM_LIMITS.items())
    return [len(words), total, len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit[5]), failed, not failed and fine, dup_chars, *cover.values()]


def run(texts):
    out = quality.make_kernel(quality.NGRAM_LIMITS, quality.LINE_LIMIT)(texts)
    return [list(row) for row in zip(*out)]


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h i j", "a b c d e " * 4, "x y\nx y\n x y\nx y\n\n\n", "é#ñ 漢字 | <b>\x0b\x0c\r q", "w " * 5000, "\x85a\xa0b \x1cc"]


def test_odd_texts_equal_brute_force():
    assert run(TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é\x1c", max_size=120), max_size=5))
def test_dense_texts_equal_brute_force(texts):
    assert run(texts) == [brute(t) for t in texts]


def test_windows_cut_on_blanks(monkeypatch):
    from tidemark.llm import hashing

    monkeypatch.setattr(hashing, "WINDOW", 7)
    assert run(TEXTS[:8]) == [brute(t) for t in TEXTS[:8]]


def test_frame(spark):
    rows = [(i, t, True) for i, t in enumerate(TEXTS)] + [(None, "a b", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    out = quality.repetition_quality(df, keep=["doc_id"]).collect()
    assert len(out) == len(rows) and out[0].n_words == 0 and not out[0].kept
    assert quality.repetition_quality(df.limit(0)).count() == 0


def test_very_long_texts():
    prose = " ".join(f"w{i % 70_001}" for i in range(70_001))
    texts = ["x" * 10_000_000, prose, f"{prose} {prose}", "line of some words\n" * 400_000]
    got = run(texts)
    assert got[0][:2] == [1, 10_000_000] and got[0][5:7] == [True, False]
    assert got[1] == brute(prose) and got[1][6]
    assert got[2][0] == got[2][4] == 140_002 and not got[2][6]
    assert got[3][:5] == [1_600_000, 6_000_000, 0, 399_999, 1_600_000]
