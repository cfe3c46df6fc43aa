import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import langid


def brute_bits(training, text):
    """PPM with exclusion, byte by byte, from raw counts."""
    counts = {}
    for t in training:
        s = b"\n\n\n" + t.encode()
        for i in range(3, len(s)):
            for k in range(4):
                counts.setdefault((k, s[i - k : i]), Counter())[s[i]] += 1
    s = b"\n\n\n" + text.encode()
    bits = 0.0
    for i in range(3, len(s)):
        k = next(k for k in (3, 2, 1, 0) if (k, s[i - k : i]) in counts)
        p, seen = 1.0, set()
        while True:
            own = {x: c for x, c in counts[(k, s[i - k : i])].items() if x not in seen}
            n, q = sum(own.values()), len(own)
            if s[i] in own:
                p *= own[s[i]] / (n + q)
                break
            if q:
                p *= q / (n + q)
            seen |= set(own)
            if k == 0:
                p /= 256 - len(seen)
                break
            k -= 1
        bits -= math.log2(p)
    return bits


SAMPLE = [("en", "the cat and the dog and the bird sat on the mat. the end and then"), ("en", "then there was the other one"), ("fr", "le chat et le chien et l'oiseau étaient là. la fin et puis voilà"), ("fr", "il y avait une autre été"), ("ru", "кот и пёс сидели на ковре, и птица"), ("el", "η γάτα και ο σκύλος κάθισαν")]


def test_code_lengths_equal_brute_force():
    model = langid.Model(SAMPLE)
    texts = ["the hat", "été là", "zzz", "", "x" * 50, "the\n\nle 漢", "мир и кот", "ÿ\x00\x7f"]
    got = model.lengths([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(brute_bits([t for l, t in SAMPLE if l == lang], text), rel=1e-5, abs=1e-4)


def test_blocks_do_not_change_lengths(monkeypatch):
    model = langid.Model(SAMPLE)
    raw = [b"", b"the cat " * 40, b"le chat", b"", "кот".encode(), b""]
    whole = model.lengths(raw)
    monkeypatch.setattr(langid, "BLOCK", 11)
    assert np.allclose(whole, model.lengths(raw))


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.train(docs), keep=["doc_id", "lang"], real=False).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    rows = [(1, "the cat", "en", "x"), (2, None, "fr", "x"), (None, "été", None, "x"), (4, "12 !", "fr", None), (4, "12 !", "fr", None), (5, "", None, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(odd, langid.Model(SAMPLE), keep=["doc_id"]).collect()
    assert [r.lang_pred for r in got] == ["en", "und", "fr", "und", "und", "und"]
    empty = odd.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}


def test_scripts_and_long_texts(spark):
    """Languages in many scripts, with more different bytes than any one has, and texts of 10 MB."""
    rng = random.Random(2)
    scripts = {"ru": "абвгдежзийклмнопрст", "el": "αβγδεζηθικλμνξοπρστυ", "he": "אבגדהוזחטיכלמנסעפצ", "ja": "あいうえおかきくけこさしすせそ", "zh": "的一是不了人我在有他这中大来上", "en": "abcdefghijklmnopqrst", "sw": "aeiounmwkzhjgbdytlsr"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(2, 7))) for _ in range(120)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(1000 * i + j, text(k, 60), k) for i, k in enumerate(scripts) for j in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted(scripts)
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, model, real=False).collect())
    long = [(i, text(k, 1000) * (10_000_000 // len(text(k, 1000))), k) for i, k in enumerate(("ru", "sw"))] + [(5, "x" * 10_000_000, "-")]
    got = langid.predict(spark.createDataFrame(long, "doc_id long, text string, lang string"), model, keep=["doc_id", "lang"]).collect()
    assert [r.lang_pred == r.lang for r in got][:2] == [True] * 2 and len(got) == 3
