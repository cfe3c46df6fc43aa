"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

For each length n the hashes of all n-word windows of a text are sorted; windows
found twice or more mark their words, and the characters of marked words over
the characters of all words are the coverage at n. A window of n + 1 words can
only repeat if its first n words do, so lengths after one without repeats are
skipped. Lines equal to an earlier line are measured likewise.

Null, empty and blank texts have no words: all counts are 0 and they fail the
base rule. Repeated rows are measured each. Memory is bounded by the longest text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import annotate, ship
from tidemark.llm.hashing import BLANKS, hash_words, join_texts, mix, separators

ship(__name__)

#: Largest share of characters inside windows of n words that occur twice or more.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of characters inside lines equal to an earlier one. A heading and a footing that repeat once stay below all limits.
LINE_LIMIT = 0.30
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("dup_line_chars", T.LongType()),
    *(T.StructField(f"dup_chars_{n}", T.LongType()) for n in NGRAM_LIMITS),
]


def repeated(hashes: np.ndarray) -> np.ndarray | None:
    """Flags of the values found twice or more, or None if there are none."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    flag = np.zeros(len(s), bool)
    flag[1:] = same
    flag[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = flag
    return out


def covered(flag: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any flagged window of n words."""
    edge = np.zeros(words + 1, np.int64)
    edge[: len(flag)] += flag
    edge[n : n + len(flag)] -= flag
    return np.cumsum(edge[:-1]) > 0


def make_kernel(limits: dict[int, float], line_limit: float):
    blank, symbol = separators(BLANKS), separators(SYMBOLS)
    lengths = sorted(limits)

    def kernel(texts: list[str | None]) -> list[list]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data, starts = join_texts(raw)
        begin, end, words = hash_words(data, blank)
        first = np.searchsorted(begin, starts)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        marks = np.concatenate([[0], np.cumsum(symbol[data])])
        width = chars[end] - chars[begin]
        out: list[list] = [[] for _ in FIELDS]
        for i, text in enumerate(texts):
            lo, hi = first[i], first[i + 1]
            n, w, h = int(hi - lo), width[lo:hi], words[lo:hi]
            total = int(w.sum())
            dup_lines = dup_line_chars = 0
            if text and "\n" in text:
                seen = set()
                for line in text.split("\n"):
                    if line.strip(" \t\r\v\f"):
                        if line in seen:
                            dup_lines += 1
                            dup_line_chars += len(line) - sum(map(line.count, " \t\r\v\f"))
                        seen.add(line)
            dup = dict.fromkeys(lengths, 0)
            repeat_words, g, k = 0, h, 1
            with np.errstate(over="ignore"):
                for length in sorted({5, *lengths}):
                    if n < length:
                        break
                    while k < length:  # the hash of k + 1 words from that of k
                        g = g[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
                        k += 1
                    flag = repeated(mix(g))
                    if flag is None:
                        break
                    mask = covered(flag, length, n)
                    if length == 5:
                        repeat_words = int(mask.sum())
                    if length in dup:
                        dup[length] = int(w[mask].sum())
            failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
            fine = dup_line_chars <= line_limit * total and all(dup[k] <= limits[k] * total for k in lengths)
            row = [n, total, int(marks[starts[i + 1]] - marks[starts[i]]), dup_lines, repeat_words, failed, not failed and fine, dup_line_chars, *dup.values()]
            for column, value in zip(out, row):
                column.append(value)
        return out

    return kernel


def repetition_quality(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Appends the base counts, the coverage and the verdict to each document, in one pass without a shuffle."""
    limits = limits or NGRAM_LIMITS
    fields = [*FIELDS[:8], *(T.StructField(f"dup_chars_{n}", T.LongType()) for n in sorted(limits))]
    return annotate(docs, [text_col], lambda _: make_kernel(limits, line_limit), fields, keep=keep)
