"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each
character of a word; dynamic programming carries the best score and the number
of pieces of the best path, nothing else. Rules are those of the public unigram
tokenizer: words begin at each blank, which is written as a low line; of paths
with equal scores to a place the one with the longest last piece stands; a
character that is no piece costs the least score less 10 and counts as its
UTF-8 bytes if the vocabulary has byte pieces, else as one, with its neighbours.

Null and empty texts have 0 tokens. Repeated rows are counted each. Memory: the
automaton of the vocabulary and a bounded cache of words a worker.
"""

from __future__ import annotations

import hashlib
import math
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.bpe import _Cache
from tidemark.llm.common import annotate, kept_model, ship

ship(__name__)

BLANK = "▁"
UNKNOWN_COST = 10.0
CACHE_WORDS = 1 << 18
#: Characters from which a word's tables are arrays.
LONG = 4096
NEVER = float("-inf")

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_fallback", T.LongType())]


def public_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores: the log of a Zipf share by id, control pieces last."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    rank = {i: k for k, i in enumerate(plain)}
    total = math.log(sum(1 / (k + 1) for k in range(n)))
    return [(model.id_to_piece(i), -math.log(rank.get(i, n - 1) + 1) - total) for i in range(n)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        known = {}
        for piece, score in vocabulary:
            if piece:
                known[piece] = score
        for piece, score in known.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p in known if len(p) == 1}
        self.unknown = min(known.values()) - UNKNOWN_COST
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.words = _Cache(self.word, CACHE_WORDS)

    def word(self, word: str) -> int:
        """Pieces of a word, and those of them that stand for unknown characters, as pieces << 32 | unknown."""
        n = len(word)
        if n <= LONG:
            best, count, odd, run = [0.0] + [NEVER] * n, [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        else:  # the same in 25 bytes a character
            best, count, odd, run = array("d", [0.0]) + array("d", [NEVER]) * n, array("q", bytes(8 * n + 8)), array("q", bytes(8 * n + 8)), bytearray(n + 1)
        single = self.single

        def unknown(end: int) -> None:
            score = self.unknown + best[end - 1]
            if score > best[end]:
                size = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not run[end - 1])
                best[end], count[end], odd[end], run[end] = score, count[end - 1] + size, odd[end - 1] + size, True

        done = 0
        for last, (size, score) in self.machine.iter(word):  # by end, and of one end the longest first
            end = last + 1
            while done < end - 1:
                done += 1
                if word[done - 1] not in single:
                    unknown(done)
            score += best[end - size]
            if score > best[end]:
                best[end], count[end], odd[end], run[end] = score, count[end - size] + 1, odd[end - size], False
        while done < n:
            done += 1
            if word[done - 1] not in single:
                unknown(done)
        return count[n] << 32 | odd[n]

    def count(self, text: str | None) -> tuple[int, int, int]:
        if not text:
            return 0, 0, 0
        words = text.replace(BLANK, " ").split(" ")  # a low line of the text itself begins a word too
        if not words[0]:  # the text begins with a blank: it is the first word's
            words = words[1:]
        packed = [self.words[BLANK + w] for w in words]
        return sum(p >> 32 for p in packed), len(packed), sum(p & 0xFFFFFFFF for p in packed)


def make_kernel(vocabulary: list[tuple[str, float]]):
    counter = kept_model((__name__, hashlib.sha256(repr(vocabulary).encode()).digest()), lambda: Counter(vocabulary))

    def kernel(texts: list[str | None]) -> list[list]:
        return [list(c) for c in zip(*map(counter.count, texts))] or [[], [], []]

    return kernel


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends n_tokens, n_words and n_fallback; one pass without a shuffle. The vocabulary is broadcast: it is a file's, some 32,000 pieces."""
    return annotate(docs, [text_col], make_kernel, FIELDS, payload=vocabulary, keep=keep)
