"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 3 with frozen counts. The code
length of a byte is that of its longest known context: the symbol's count there
or an escape to the next shorter context, where symbols of the longer one are
excluded (escape method C), down to a uniform share of the 256 bytes. As
statistics are frozen, these exact lengths are tabled for each context and byte
once; bytes that the whole sample lacks have equal lengths everywhere and share
a column, which changes no length. A text is scored by table lookups in numpy,
block by block, and the language with the shortest total wins. The score is its
posterior under equal priors.

Null texts and texts without a letter are `und` with score 0. Ties go to the
language that sorts first. With no labelled documents all texts are `und`.
Repeated rows are scored each. The fit uses at most `SAMPLE` documents a
language of at most `SAMPLE_BYTES` (longer ones by a slice); scoring reads whole
texts, without a shuffle. A language's tables have a row a context met, some
10 MB for languages of 100 different bytes in all, 40 MB for 256.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import annotate, ship
from tidemark.llm.samples import fold, sample_texts

ship(__name__)

#: Bounds of the training sample: documents a language, and bytes of one of them.
SAMPLE = 300
SAMPLE_BYTES = 1 << 15
FOLDS, HELD_OUT = 4, 2
ORDER = 3
BYTES = 256
#: Contexts met less often are left to their shorter one.
MIN_CONTEXT = 1
BLOCK = 1 << 18

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
REAL_FIELDS = [*FIELDS, T.StructField("bits", T.MapType(T.StringType(), T.DoubleType()))]
_GAP = b"\n" * ORDER


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, line ends before each, with their begins and ends."""
    size = np.array([len(r) for r in raw], np.int64)
    begin = np.cumsum(size + ORDER) - size
    return np.frombuffer(b"".join(x for r in raw for x in (_GAP, r)), np.uint8), begin, begin + size


def contexts(symbols: np.ndarray, order: int, size: int) -> np.ndarray:
    """The number of the `order` symbols before each place, from place ORDER on."""
    code = np.zeros(len(symbols) - ORDER, np.int64)
    for j in range(order, 0, -1):
        code = code * size + symbols[ORDER - j : len(symbols) - j]
    return code


class Tree:
    """One language's frozen context tree, as code lengths of every context and symbol.

    Symbols are the bytes of the sample, from 1, and 0 for any other byte.
    """

    def __init__(self, symbols: np.ndarray, real: np.ndarray, size: int):
        now, self.size = symbols[ORDER:][real], size
        nodes: list[np.ndarray] = []  # context numbers of each order, sorted
        counts: list[np.ndarray] = []  # their symbol counts
        for k in range(ORDER + 1):
            known, place, total = np.unique(contexts(symbols, k, size)[real], return_inverse=True, return_counts=True)
            often = total >= (MIN_CONTEXT if k else 0)
            rank, own = np.cumsum(often) - 1, often[place]
            nodes.append(known[often])
            counts.append(np.bincount(rank[place[own]] * size + now[own], minlength=int(often.sum()) * size).reshape(-1, size).astype(np.int32))
        first = np.cumsum([0, *map(len, nodes)])
        # the last two symbols lead to a row, the one before them to the node of the longest known suffix
        single = np.zeros(size, np.int32)
        single[nodes[1]] = np.arange(first[1], first[2])
        self.row = np.tile(np.arange(size, dtype=np.int32), size)
        self.row[nodes[2]] = size + np.arange(len(nodes[2]))
        self.node = np.concatenate([single, np.arange(first[2], first[3])]).astype(np.int32)[:, None].repeat(size, 1)
        self.node[self.row[nodes[3] % size**2], nodes[3] // size**2] = np.arange(first[3], first[4])
        self.node = self.node.ravel()
        self.bits = np.concatenate([self._lengths(nodes, counts, k, at) for k in range(ORDER + 1) for at in range(0, len(nodes[k]), 4096)] or [np.zeros((0, size), np.float32)]).ravel()

    def _lengths(self, nodes: list[np.ndarray], counts: list[np.ndarray], k: int, begin: int) -> np.ndarray:
        """Code lengths of all symbols in some contexts of order k."""
        own = nodes[k][begin : begin + 4096]
        p, escape, seen = np.zeros((len(own), self.size)), np.ones((len(own), 1)), np.zeros((len(own), self.size), bool)
        for j in range(k, -1, -1):
            c = np.where(seen, 0, counts[j][np.searchsorted(nodes[j], own % self.size**j)])
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            whole = np.maximum(total + kinds, 1)
            p += np.where(c > 0, escape * c / whole, 0)
            escape = np.where(kinds > 0, escape * kinds / whole, escape)
            seen |= c > 0
        left = BYTES - seen.sum(1, keepdims=True)
        p += np.where(seen, 0, escape / np.maximum(left, 1))
        return -np.log2(np.maximum(p, 1e-300)).astype(np.float32)

    def lengths(self, s: np.ndarray) -> np.ndarray:
        """Code length of each symbol from place ORDER on."""
        size = self.size
        node = self.node[self.row[s[1:-2] * size + s[2:-1]] * size + s[:-3]]
        return self.bits[node * np.int64(size) + s[3:]]


class Model:
    def __init__(self, sample: list[tuple[str, str]]):
        by: dict[str, list[bytes]] = {}
        for lang, text in sample:
            by.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        self.langs = sorted(by)
        met = sorted({10}.union(*(r for own in by.values() for r in own)))
        self.symbol = np.zeros(BYTES, np.int32)
        self.symbol[met] = np.arange(1, len(met) + 1)
        self.trees = []
        for lang in self.langs:
            data, begin, end = joined(by[lang])
            real = np.zeros(len(data) + 1, np.int8)
            np.add.at(real, begin, 1)
            np.add.at(real, end, -1)
            self.trees.append(Tree(self.symbol[data], np.cumsum(real)[ORDER:-1] > 0, len(met) + 1))

    def lengths(self, raw: list[bytes]) -> np.ndarray:
        """Code lengths in bits, a row for each text and a column for each language."""
        data, begin, end = joined(raw)
        out = np.zeros((len(raw), len(self.trees)))
        for at in range(ORDER, len(data), BLOCK):
            to = min(len(data), at + BLOCK)
            s = self.symbol[data[at - ORDER : to]]
            lo, hi = np.searchsorted(end, at, side="right"), np.searchsorted(begin, to, side="left")
            b, e = np.clip(begin[lo:hi], at, to) - at, np.clip(end[lo:hi], at, to) - at
            total = np.zeros(to - at + 1)
            for k, tree in enumerate(self.trees):
                np.cumsum(tree.lengths(s), dtype=np.float64, out=total[1:])
                out[lo:hi, k] += total[e] - total[b]
        return out


def make_kernel(real: bool):
    def make(model: Model):
        letter = regex.compile(r"\p{L}").search

        def kernel(texts: list[str | None]) -> list[list]:
            bits = model.lengths([(t or "").encode("utf-8", "surrogatepass") for t in texts])
            pred, score = [], []
            for text, own in zip(texts, bits):
                if not len(own) or not text or not letter(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(own.argmin())
                pred.append(model.langs[best])
                score.append(float(1 / np.exp2(np.maximum(own[best] - own, -1000)).sum()))
            out = [pred, score]
            return [*out, [list(zip(model.langs, map(float, own))) for own in bits]] if real else out

        return kernel

    return make


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: bool = True, per_lang: int = SAMPLE, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from labelled documents, without those of the held-out fold."""
    own = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    if held_out:
        own = own.where(fold(id_col, FOLDS) != HELD_OUT)
    named = own.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(f"`{lang_col}`").alias("label"))
    return Model(sample_texts(docs, named, per_lang, max_bytes, id_col, text_col))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, real: bool = True) -> DataFrame:
    """Appends lang_pred and score and, with `real`, every language's code length in bits."""
    return annotate(docs, [text_col], make_kernel(real), REAL_FIELDS if real else FIELDS, payload=model, keep=keep)
