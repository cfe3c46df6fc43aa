import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(open(PATH, "rb").read())

ODD = [
    "", " ", "a", "  The cat's  12 dogs!!", "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z", "ΑΣ ΟΔΟΣ", "İstanbul", "é é", "a\x1cb \x1f c", "a b　c\x85d",
    "don't we'll I'd THEY'RE", "🎉🎉 party", "ﬁ ǅ ẞ", "a" * 1000, "ab" * 700 + "!", "́x", "<|", "naïve\tçа", "½ ² ३", "​﻿", "x" * 70 + " " + "y" * 63,
]


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False)
    ids = CODEC.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids
    assert CODEC.decode(ids) == LIBRARY.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_equal_the_library(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbeé'!1 Σñ́\x1c\xa0<|>endoftxt", max_size=40))
def test_dense_text_equals_the_library(text):
    check(text)


def test_long_words_merge_alike():
    for word in ("lo" * 150, "the" * 120, "xqz" * 99):
        parts = [CODEC.inner[b] for b in word.encode()]
        parts[-1] = CODEC.last[word.encode()[-1]]
        assert list(CODEC.merge_long(parts)) == list(CODEC.merge(word.encode()))


def test_frame(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, None), (3, ODD[3], "x")]
    out = bpe.encode(spark.createDataFrame(rows, schema), PATH, keep=["doc_id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        text = ODD[r.doc_id] if r.doc_id is not None else ""
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and LIBRARY.decode(want, skip_special_tokens=False) == r.decoded
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert bpe.encode(spark.createDataFrame([], schema), PATH).count() == 0


def test_very_long_words_and_texts():
    rng = random.Random(1)
    for text in ("x" * 50_000, "".join(rng.choices("abcdefghijklmnopqrst", k=50_000)), "".join(rng.choices("theandofing", k=50_000)), "".join(rng.choices("étèlañ", k=20_000)), " ".join(rng.choices(["word", "of", "prose", "y" * 3000], k=3000))):
        check(text)
    assert len(CODEC.encode("lo" * 1_000_000)) % 4 == 0
