"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or.

Only documents have labels. A document is toxic if any sentence is: with p the
logistic score of a sentence, a document scores 1 - product(1 - p). Sentence
weights are trained through that formula from document labels, so the blame
falls on the sentences that tell toxic documents from others; these are located
with their own score. Features are words and their first 4 to 8 bytes, hashed.

Null, empty and wordless texts score 0. Repeated rows are scored each; an id
labelled twice takes the larger label. Without toxic labels all weights are 0
and every score is near 0. The fit uses at most `SAMPLE` documents a label of
at most `SAMPLE_BYTES` (longer ones by a slice, if there are too few others);
scoring reads whole texts, without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import annotate, ship
from tidemark.llm.hashing import hash_words, join_texts, separators
from tidemark.llm.samples import fold, sample_texts

ship(__name__)

#: Bounds of the training sample: documents a label, and bytes of one of them.
SAMPLE = 3000
SAMPLE_BYTES = 1 << 15
FOLDS = 5
BITS = 18
#: Least log-likelihood ratio of a feature between toxic and other documents.
MIN_GAIN = 22.0
#: Bounds of the bias: sentences without telling words must stay clean, however many a document has.
BIAS = (-12.0, -8.0)
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.5
_WORDLESS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
SENTENCES = T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))


def featurize(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of all words of the texts: feature rows (-1: none), sentence numbers, begins, ends; then the texts' first words, the buffer and the texts' places."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data, starts = join_texts(raw)
    data = data.copy()
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1  # Latin letters with marks
    upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E) & (data[upper] != 0x97)]
    data[upper] += 0x20
    stop = separators(b".!?\n")[data]
    begin, end, whole, *prefix = hash_words(data, separators(_WORDLESS), PREFIXES)
    rows = np.empty((1 + len(PREFIXES), len(begin)), np.int32)
    shift = np.uint64(64 - BITS)
    rows[0] = (whole >> shift).astype(np.int32)
    sentence = np.cumsum(stop)[begin] if len(begin) else np.zeros(0, np.int64)
    again = np.flatnonzero((whole[1:] == whole[:-1]) & (sentence[1:] == sentence[:-1])) + 1  # a word said over and over counts once
    for r, h in zip(rows[1:], prefix):
        r[:] = np.where(h == 0, -1, (h >> shift).astype(np.int32))
    rows[:, again] = -1
    return rows, sentence, begin, end, np.searchsorted(begin, starts), data, starts


def unlike(sample: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The sample without near copies of an earlier text, whose rare words would look telling."""
    seen: set[tuple] = set()
    out = []
    for label, text in sample:
        words = np.unique(featurize([text])[0][0].view(np.uint32))
        if len(words) >= 8:
            least = [int((words * np.uint32(a)).min()) for a in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491)]
            keys = [(i, *least[i : i + 2]) for i in (0, 2, 4)]
            if any(k in seen for k in keys):
                continue
            seen.update(keys)
        out.append((label, text))
    return out


def objective(w: np.ndarray, bias: float, labels: np.ndarray, importance: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, plain: np.ndarray, decay: float) -> tuple[float, np.ndarray, float]:
    """The noisy-or loss of document labels and its gradient by the weights and the bias.

    `doc` is the document of each sentence that has chosen features, `sentence`
    and `feature` are the pairs of these, and `plain` each document's number of
    other sentences.
    """
    n = len(labels)
    z = bias + np.bincount(sentence, w[feature], minlength=len(doc))
    s = np.bincount(doc, np.logaddexp(0, z), minlength=n) + plain * np.logaddexp(0, bias)  # -log(1 - P)
    odds = np.maximum(np.expm1(np.minimum(s, 500)), 1e-6)
    loss = (importance * np.where(labels == 1, np.log1p(1 / odds), s)).sum() / n + decay * (w @ w) / (2 * n)
    pull = np.where(labels == 1, -1 / odds, 1.0) * importance / n
    dz = pull[doc] / (1 + np.exp(-z))
    dw = np.bincount(feature, dz[sentence], minlength=len(w)) + decay * w / n
    return loss, dw, dz.sum() + (pull * plain).sum() / (1 + np.exp(-bias))


def fit(sample: list[tuple[int, str]], epochs: int = 250, rate: float = 1.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of all features (one more, 0, for none) and the bias, by full-batch Adagrad on the noisy-or likelihood."""
    size = 1 << BITS
    weights = np.zeros(size + 1, np.float32)
    sample = unlike(sample)
    labels = np.array([1 if l else 0 for l, _ in sample], np.int8)
    positives, negatives = int(labels.sum()), int((labels == 0).sum())
    if not positives or not negatives:
        return weights, -12.0
    seen = np.zeros((2, size), np.int32)
    for label, text in sample:
        rows = featurize([text])[0]
        seen[1 if label else 0, np.unique(rows[rows >= 0])] += 1
    lift = np.log((seen[1] + 0.5) / (positives + 1)) - np.log((seen[0] + 0.5) / (negatives + 1))
    k, n = seen[1].astype(float), np.maximum(seen.sum(axis=0), 1).astype(float)
    base = positives / len(labels)
    gain = 2 * (k * np.log(np.maximum(k / n, 1e-9) / base) + (n - k) * np.log(np.maximum(1 - k / n, 1e-9) / (1 - base)))
    chosen = np.flatnonzero((lift > 0) & (gain > MIN_GAIN))
    index = np.full(size + 1, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    doc_of, sentence_of, feature_of, n_sentences, plain = [], [], [], [], np.zeros(len(sample))
    total = 0
    for d, (_, text) in enumerate(sample):  # keeps only sentences that have chosen features
        rows, sentence, *_ = featurize([text])
        own = index[rows]
        feature, word = own[own >= 0], np.nonzero(own >= 0)[1]
        marked, place = np.unique(sentence[word], return_inverse=True)
        plain[d] = len(np.unique(sentence)) - len(marked)
        sentence_of.append(place + total)
        feature_of.append(feature)
        doc_of.append(np.full(len(marked), d))
        total += len(marked)
    sentence_, feature_, doc_ = map(np.concatenate, (sentence_of, feature_of, doc_of))
    w = np.clip(lift[chosen], 0, 4) * 0.5
    bias = -9.0
    gw, gb = np.full(len(w), 1e-2), 1e-2
    importance = np.where(labels == 1, 0.5 / positives, 0.5 / negatives) * len(labels)
    for _ in range(epochs):
        _, dw, db = objective(w, bias, labels, importance, doc_, sentence_, feature_, plain, decay)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        bias = float(np.clip(bias - rate * db / np.sqrt(gb), *BIAS))
    weights[chosen] = w
    return weights, float(bias)


def make_kernel(real: bool):
    def make(model: tuple[np.ndarray, float]):
        weights, bias = model

        def kernel(texts: list[str | None]) -> list[list]:
            rows, sentence, begin, end, first, data, starts = featurize(texts)
            z = weights[rows].sum(axis=0)  # -1 is the last weight, 0
            n = len(texts)
            scores, where = np.zeros(n), [[] for _ in range(n)]
            if len(begin):
                head = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
                sums = np.add.reduceat(z.astype(np.float64), head) + bias
                soft = np.concatenate([[0], np.cumsum(np.logaddexp(0, sums))])
                cut = np.searchsorted(head, first)  # sentences never cross texts
                scores = -np.expm1(soft[cut[:-1]] - soft[cut[1:]])
                if real:
                    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
                    p = 1 / (1 + np.exp(-sums))
                    last = np.concatenate([head[1:], [len(begin)]]) - 1
                    for k in np.flatnonzero(p >= THRESHOLD):
                        d = int(np.searchsorted(starts, begin[head[k]], side="right")) - 1
                        zero = chars[starts[d]] - 1
                        where[d].append({"begin": int(chars[begin[head[k]]] - 1 - zero), "end": int(chars[end[last[k]] - 1] - zero), "score": float(p[k])})
            scores = np.clip(scores, 0.0, 1.0) + 0.0
            out = [scores.tolist(), (scores >= THRESHOLD).astype(int).tolist()]
            return [*out, where] if real else out

        return kernel

    return make


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int | None = FOLDS, per_label: int = SAMPLE, max_bytes: int = SAMPLE_BYTES):
    """Fits on labelled documents outside fold 0 (on all if `folds` is None); the model is the weights and the bias, about 1 MB."""
    own = labels.where(F.col(f"`{label_col}`").isin(0, 1))
    if folds:
        own = own.where(fold(id_col, folds) != 0)
    named = own.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").alias("label"))
    return fit(sample_texts(docs, named, per_label, max_bytes, id_col, text_col))


def score(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None, real: bool = True) -> DataFrame:
    """Appends score and predicted and, with `real`, the offending sentences by code points."""
    return annotate(docs, [text_col], make_kernel(real), [*FIELDS, SENTENCES] if real else FIELDS, payload=model, keep=keep)
