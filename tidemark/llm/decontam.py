"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words stream
through it, one state and one matching length at a time; wherever the length
reaches the window (8 words, or a whole item of fewer) the window's words are
hit, and the window's state tells which items hold it. Spans of hit words are
cut out of the text if their matching length reaches a limit, and the cut text is
searched again until nothing is cut, as a window can arise at a seam; a document
of which most words are hits or cut is left out. Counts are those of the first search.

Null and empty texts have no words and no hits; null items and items without
words have no windows; items with the same id count once. Repeated rows are
searched each. Items are read in blocks of bounded size, an automaton and a
pass each, so a large benchmark needs no large broadcast: the documents are then
written once with a row number, each pass writes the numbers and spans of the rows
that it hits, and these alone are brought together. An item of more than a
quarter of a block is cut into pieces that overlap by a window less a word, which
hold all its windows; the longest match is then told up to a piece's length.
"""

from __future__ import annotations

import hashlib
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import annotate, bounded, kept_model, materialize, ship

ship(__name__)

WINDOW = 8
#: Items from which a document counts as contaminated.
MIN_ITEMS = 2
#: Shares of hit words above which the pipeline's stage drops the whole document.
MAX_COVERAGE = 0.5
#: Bytes of item text in one automaton; more items are searched in further passes.
BLOCK_BYTES = 4 << 20
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("spans", T.StringType()),
    T.StructField("longest", T.LongType()),
]
REAL_FIELDS = [*FIELDS, T.StructField("items", T.ArrayType(T.StringType(), False)), T.StructField("clean_text", T.StringType()), T.StructField("stays", T.BooleanType())]
_HITS = [T.StructField("_spans", T.ArrayType(T.IntegerType(), False)), T.StructField("_items", T.ArrayType(T.StringType(), False)), T.StructField("_longest", T.LongType()), T.StructField("_any", T.BooleanType())]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Automaton:
    """The generalised suffix automaton of several word sequences, with the items of each window.

    Words are numbers. Most states have one transition; it lies in two arrays,
    and further ones in a dictionary of the state.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])  # the first transition of each state
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names = [item for item, _ in items]
        number = self.vocabulary.setdefault
        sequences = [(k, [number(w, len(self.vocabulary)) for w in words]) for k, (item, text) in enumerate(items) if item is not None and (words := words_of(text))]
        for _, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.item = array("i", [-1]) * len(self.link)  # an item of a full window's state
        self.others: dict[int, set[int]] = {}  # and further items
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> whole items of fewer words that end there
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in sequences:
            state = 0
            for i, w in enumerate(words, 1):
                state = self._step(state, w)
                if i >= window:
                    v = self._window(state)
                    if self.item[v] < 0:
                        self.item[v] = k
                    elif self.item[v] != k:
                        self.others.setdefault(v, set()).add(k)
            if len(words) < window:
                own.setdefault(state, []).append((len(words), k))
        if own:  # in order of length, so that a state's link is done before it
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                have = [*self.short.get(self.link[v], ()), *own.get(v, ())]
                if have:
                    self.short[v] = have

    def _step(self, state: int, w: int) -> int:
        """The state after a word, -1 if there is none."""
        if self.word[state] == w:
            return self.to[state]
        own = self.more.get(state)
        return own.get(w, -1) if own else -1

    def _lead(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _window(self, state: int) -> int:
        """The state of the last words of a match, as many as a window has."""
        link, length, window = self.link, self.length, self.window
        while length[link[state]] >= window:
            state = link[state]
        return state

    def _add(self, length: int, link: int, like: int = -1) -> int:
        self.word.append(self.word[like] if like >= 0 else -1)
        self.to.append(self.to[like] if like >= 0 else 0)
        self.link.append(link)
        self.length.append(length)
        new = len(self.link) - 1
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self._step(p, w) == q:
            self._lead(p, w, clone)
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self._step(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._add(self.length[last] + 1, 0), last
        while p >= 0 and self._step(p, w) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self._step(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def search(self, words: list[bytes]) -> tuple[list[int], set[str], int]:
        """Begins and ends of the runs of hit words, the items, and the longest match."""
        word, first, more, link, length, window, short = self.word, self.to, self.more, self.link, self.length, self.window, self.short
        spans: list[int] = []
        items: set[int] = set()
        state = size = longest = 0
        for i, w in enumerate(map(self.vocabulary.get, words), 1):
            if w is None:
                state = size = 0
                continue
            to = first[state] if word[state] == w else more[state].get(w, -1) if state in more else -1
            if to < 0:
                while state:
                    state = link[state]
                    to = first[state] if word[state] == w else more[state].get(w, -1) if state in more else -1
                    if to >= 0:
                        size = length[state]
                        break
                else:
                    size = 0
                    continue
            state = to
            size += 1
            begin = i
            if size >= window:
                longest = max(longest, size)
                v = self._window(state)
                items.add(self.item[v])
                items |= self.others.get(v, set())
                begin = i - window
            if short and state in short:
                for n, item in short[state]:
                    if n <= size:
                        longest = max(longest, n)
                        items.add(item)
                        begin = min(begin, i - n)
            if begin < i:
                while spans and spans[-2] >= begin:
                    del spans[-2:]
                if spans and spans[-1] >= begin:
                    spans[-1] = i
                else:
                    spans += [begin, i]
        return spans, {self.names[k] for k in items}, longest


def _merge(spans: list[list[int]]) -> list[int]:
    out: list[int] = []
    for b, e in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def cut(text: str, spans: list[int], min_words: int) -> str:
    """The text without the spans of at least so many words; a blank is left in place of each."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD))]
    out, at = [], 0
    for i in range(0, len(spans), 2):
        if spans[i + 1] - spans[i] >= min_words:
            out.append(raw[at : places[spans[i]][0]])
            at = places[spans[i + 1] - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def recut(text: str, spans: list[int], min_words: int, machine: Automaton | None) -> str:
    """The text cut and, with the automaton of all items, searched and cut until no span of so many words is left."""
    while any(e - b >= min_words for b, e in zip(spans[::2], spans[1::2])):
        text = cut(text, spans, min_words)
        spans = machine.search(words_of(text))[0] if machine else []
    return text


def _machine(items: list[tuple[str, str | None]], window: int) -> Automaton:
    return kept_model((__name__, window, hashlib.sha256(repr(items).encode("utf-8", "surrogatepass")).digest()), lambda: Automaton(items, window))


def make_kernel(real: bool, window: int, cut_words: int, coverage: float):
    """With items: searches. Without: takes what passes over blocks of items have found."""

    def make(items: list[tuple[str, str | None]] | None):
        machine = None if items is None else _machine(items, window)

        def kernel(texts, spans=None, found=None, longest=None) -> list[list]:
            out: list[list] = [[] for _ in (REAL_FIELDS if real else FIELDS)]
            for i, text in enumerate(texts):
                words = words_of(text)
                own, items_, most = machine.search(words) if machine else (_merge(spans[i] or []), set(found[i] or []), longest[i] or 0)
                hit = sum(own[1::2]) - sum(own[::2])
                names = sorted(items_)
                row = [len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= MIN_ITEMS]
                row += [",".join(f"{b}:{e}" for b, e in zip(own[::2], own[1::2])), most]
                if real:
                    clean = recut(text, own, cut_words, machine)
                    gone = len(words) - len(words_of(clean)) if own else 0
                    row += [names, clean, max(hit, gone) <= coverage * len(words)]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return kernel

    return make


def make_pass(window: int):
    def make(items: list[tuple[str, str | None]]):
        machine = _machine(items, window)

        def kernel(texts) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                own, items_, most = machine.search(words_of(text))
                for column, value in zip(out, (own, sorted(items_), most, bool(own))):
                    column.append(value)
            return out

        return kernel

    return make


def make_recut(cut_words: int, coverage: float):
    """After all blocks have searched the cut text: the text cut again, whether the document stays, and whether anything was cut."""

    def kernel(texts, words, stays, spans) -> list[list]:
        out: list[list] = [[], [], []]
        for text, n, stay, own in zip(texts, words, stays, spans):
            clean = recut(text, _merge(own or []), cut_words, None)
            for column, value in zip(out, (clean, stay and n - len(words_of(clean)) <= coverage * n, clean != text)):
                column.append(value)
        return out

    return lambda _: kernel


def pieces(text: str | None, window: int, limit: int) -> list[str]:
    """An item's words as texts of about `limit` bytes at most, each with a window's words at least, that hold all its windows."""
    words, out, at = words_of(text), [], 0
    while words:
        to, size = at, 0
        while to < len(words) and (to - at < window or size + len(words[to]) < limit):
            size += len(words[to]) + 1
            to += 1
        out.append(b" ".join(words[at:to]).decode("utf-8", "surrogatepass"))
        if to == len(words):
            break
        at = to - window + 1
    return out


def make_pieces(window: int, limit: int):
    return lambda _: lambda texts: [[pieces(t, window, limit) for t in texts]]


class Items:
    """The items in blocks, each of a bounded number of bytes whatever single items have."""

    def __init__(self, items: DataFrame, window: int, block_bytes: int):
        named = items.where("item is not null and octet_length(text) > 0")
        size = F.sum(F.octet_length("item") + F.octet_length("text"))
        total = int(named.agg(size).first()[0] or 0)
        self.n, self.parts = 1, named
        if total > block_bytes:
            cut = annotate(named, ["text"], make_pieces(window, block_bytes // 4), [T.StructField("piece", T.ArrayType(T.StringType(), False))], keep=["item"])
            self.parts = materialize(cut.select("item", F.explode("piece").alias("text")).distinct(), "items")
            self.n = 2 * -(-total // block_bytes)
            while self.n < total and self.parts.groupBy(self._block()).agg(size.alias("size")).agg(F.max("size")).first()[0] > 2 * block_bytes:
                self.n *= 2

    def _block(self):
        return F.pmod(F.xxhash64("item", "text"), F.lit(self.n))

    def rows(self, block: int) -> list[tuple[str, str]]:
        part = self.parts if self.n == 1 else self.parts.where(self._block() == block)
        return sorted({(r.item, r.text) for r in part.toLocalIterator()})

    def find(self, docs: DataFrame, number: str, text: str, window: int) -> DataFrame:
        """Of the rows that any block hits: the number, and each block's spans, the items and the longest match."""
        found = None
        for b in range(self.n):
            hit = materialize(annotate(docs, [text], make_pass(window), _HITS, payload=self.rows(b), keep=[number], where=3).drop("_any"), f"block-{b}")
            found = hit if found is None else found.unionByName(hit)
        return materialize(found.groupBy(number).agg(F.collect_list("_spans").alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"), F.max("_longest").alias("_longest")), "hits")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    cut_words: int = 1,
    coverage: float = MAX_COVERAGE,
    real: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Appends the counts, the items' digest, the verdict, the spans (by words) and, with `real`, the items, the cut text and whether the document stays.

    `cut_words` is the least length of a hit run that is cut out of clean_text
    (a run is at least one window, or a whole short item). With one block of
    items there is no shuffle: it is broadcast and the documents stream past it.
    With several, texts that were cut are searched again in passes of their own.
    """
    blocks = Items(items.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")), window, block_bytes)
    keep = list(docs.columns if keep is None else keep)
    fields, kernel = REAL_FIELDS if real else FIELDS, make_kernel(real, window, cut_words, coverage)
    if blocks.n == 1:
        return annotate(docs, [text_col], kernel, fields, payload=blocks.rows(0), keep=keep)
    names = {f.name for f in fields}
    stay = [c for c in keep if c not in names]
    row, number, text = "_row", "_number", "_text"
    docs = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in stay if c != text_col)).alias(row), F.col(f"`{text_col}`").alias(text))
    docs = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    hits = blocks.find(docs.select(number, text), number, text, window)
    ids = bounded(hits.select(number))
    met = docs.join(ids, number, "left_semi").join(hits, number)
    rest = docs.join(ids, number, "left_anti")
    carried = ["_spans", "_items", "_longest"]
    for c in carried:
        rest = rest.withColumn(c, F.lit(None).cast(hits.schema[c].dataType))
    done = annotate(met.unionByName(rest, allowMissingColumns=True), [text, *carried], kernel, fields, keep=[row, number, text])
    if real:
        done = materialize(done, "cut")
        open_ = done.where("n_hit > 0")
        done = done.where("n_hit = 0")
        columns, again = done.columns, [T.StructField("clean_text", T.StringType()), T.StructField("stays", T.BooleanType()), T.StructField("_again", T.BooleanType())]
        while not open_.isEmpty():  # a round has at least a word less in each open text
            found = blocks.find(open_.select(number, "clean_text"), number, "clean_text", window)
            found = open_.join(found.select(number, "_spans"), number, "left")
            found = materialize(annotate(found, ["clean_text", "n_words", "stays", "_spans"], make_recut(cut_words, coverage), again, keep=columns), "recut")
            done = done.unionByName(found.where("not _again").select(columns))
            open_ = found.where("_again").select(columns)
    own = [F.col(text).alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in stay]
    return done.select(*own, *names_of(fields))


def names_of(fields: list[T.StructField]) -> list[str]:
    return [f.name for f in fields]
