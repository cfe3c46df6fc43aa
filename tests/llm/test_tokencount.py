import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import tokencount

VOCABULARY = tokencount.public_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
SMALL = [("<unk>", -9.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("▁a", -3.0), ("ba", -2.5), ("aba", -3.5), ("bb", -3.0), ("abab", -5.0)]


def library(vocabulary, fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


LARGE_LIBRARY, SMALL_LIBRARY = library(VOCABULARY, True), library(SMALL, False)
LARGE, LITTLE = tokencount.Counter(VOCABULARY), tokencount.Counter(SMALL)
ODD = ["", " ", "a", "  two  blanks ", "The quick brown fox\njumps.", "漢字🎉 é", "▁x ▁▁y", "<0x41> <s>", "thththth" * 40, "á\x00b"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_the_library(text):
    assert LARGE.count(text)[0] == len(LARGE_LIBRARY.encode(text).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=50))
def test_any_text_equals_the_library(text):
    assert LARGE.count(text)[0] == len(LARGE_LIBRARY.encode(text).ids)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab xyé", max_size=30))
def test_ties_and_unknown_runs_equal_the_library(text):
    assert LITTLE.count(text)[0] == len(SMALL_LIBRARY.encode(text).ids)


def test_frame(spark):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = tokencount.count_tokens(df, VOCABULARY, keep=["doc_id"]).collect()
    assert [r.n_tokens for r in out] == [len(LARGE_LIBRARY.encode(t).ids) for t in ODD] + [0, 0]
    assert tokencount.count_tokens(df.limit(0), VOCABULARY).count() == 0


def test_very_long_words_and_texts():
    rng = random.Random(1)
    for word in ("x" * 60_000, "".join(rng.choices("abcdefghij漢é", k=60_000)), " ".join(rng.choices(["word", "of", "prose", "x" * 5000], k=3000))):
        assert LARGE.count(word)[0] == len(LARGE_LIBRARY.encode(word).ids)
    word = "".join(rng.choices("ab xyé", k=9000))
    assert LITTLE.count(word)[0] == len(SMALL_LIBRARY.encode(word).ids)
    assert LARGE.count("ab" * 2_000_000)[1:] == (1, 0)
