"""BPE encoding and decoding with a contiguous rank array per short word.

A word is held as its parts and the merge rank of every adjacent pair, side by
side. The smallest rank is searched by a scan (first of equals), that boundary
is deleted, and only the two neighbouring ranks are looked up anew. Words are
split, normalized and mapped as the vocabulary file says (NFC, white space,
lower case, one digit a word, a word-end mark), so ids equal the public
library's; decoding joins the pieces with spaces, as a file without a decoder does.

Null counts as an empty text: no ids, empty decoded text. Repeated rows are
encoded each. Memory: the vocabulary (bounded by its file) and a cache of words
of at most `CACHE_WORDS` entries a worker; long words are merged uncached.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import annotate, kept_model, ship

ship(__name__)

CACHE_WORDS = 1 << 17
#: Longer white-space-free stretches are encoded without being kept.
CACHE_CHARS = 64
#: Parts up to which ranks are scanned; beyond it places are kept by rank, with the same minima, to keep long words from quadratic time.
SCAN_PARTS = 400
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Ranges whose letters and numbers are newer than the Unicode tables that the vocabulary's library splits by.
_NEWER = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2,
    0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959),
    (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f),
    (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff3), (0x16ff4, 0x16ff6), (0x187f8, 0x187ff),
    (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2),
    (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
#: Lower case newer than this Python's tables: first upper, last upper, distance.
_NEWER_CASES = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27)]
_LOWER = {i: i + d for a, b, d in _NEWER_CASES for i in range(a, b + 1)} | {0x3A3: 0x3C3}  # and a sigma has one lower case here
SHIFT = 20
_NEVER = 1 << 50
_ID = (1 << SHIFT) - 1
_SIMPLE = frozenset(".,!?;:")

FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]
PACKED = T.StructField("ids_le", T.BinaryType())
REAL_FIELDS = [*FIELDS, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class _Cache(dict):
    """Key -> atomic value, filled on demand by `make`; of two generations the older one goes when the newer is full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHARS:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """A word-end BPE vocabulary file, its merges as ranks of id pairs."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.pieces = {i: p for p, i in vocab.items()}
        self.ranks: dict[int, int] = {}  # two ids -> rank and merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << SHIFT | vocab[b], rank << SHIFT | vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces.update({i: t for t, i in self.special.items()})
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        newer = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _NEWER) + "]"
        pattern = split["pattern"]["Regex"]
        for kind in ("\\p{L}", "\\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--{newer}]")
        self.words = regex.compile(pattern, regex.V1)
        self.space = regex.compile(_SPACE)
        self.odd = regex.compile("[\x1c-\x1f]")
        self.table = [self.pieces.get(i, "") for i in range(max(self.pieces) + 1)]
        self.word_ids = _Cache(lambda w: array("I", self.merge(w.encode("utf-8", "surrogatepass"))).tobytes(), CACHE_WORDS)
        self.ids = _Cache(lambda s: b"".join(map(self.word_ids.__getitem__, self.split(s))), CACHE_WORDS)

    def merge(self, word: bytes) -> list[int] | array:
        """The ids of one word, by the rank array."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        n = len(parts)
        if n > SCAN_PARTS:
            return self.merge_long(parts)
        get = self.ranks.get
        pairs = [get(a << SHIFT | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                break
            i = pairs.index(best)
            parts[i] = best & _ID
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] << SHIFT | parts[i], _NEVER)
            if i < len(pairs):
                pairs[i] = get(parts[i] << SHIFT | parts[i + 1], _NEVER)
        return parts

    def merge_long(self, parts: list[int]) -> array:
        """The same merges for a very long word: places by rank, lowest rank first, over linked parts; some 30 bytes a part."""
        import heapq

        n, get = len(parts), self.ranks.get
        parts, after, before = array("i", parts), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        places: dict[int, array] = {}
        heap: list[int] = []

        def note(i: int, rank: int) -> None:
            if rank in places:
                places[rank].append(i)
            else:
                places[rank] = array("i", [i])
                heapq.heappush(heap, rank)

        for i in range(n - 1):
            if (r := get(parts[i] << SHIFT | parts[i + 1])) is not None:
                note(i, r >> SHIFT)
        while heap:
            rank = heapq.heappop(heap)
            own = np.sort(np.frombuffer(places.pop(rank), np.int32))
            for at in range(0, len(own), 1 << 16):
                for i in own[at : at + (1 << 16)].tolist():
                    j = after[i]
                    if parts[i] < 0 or j >= n or (r := get(parts[i] << SHIFT | parts[j])) is None or r >> SHIFT != rank:
                        continue  # a part of the pair has become another meanwhile
                    parts[i], parts[j] = r & _ID, -1
                    after[i] = after[j]
                    if after[j] < n:
                        before[after[j]] = i
                    for x in (before[i], i):
                        if x >= 0 and after[x] < n and (r := get(parts[x] << SHIFT | parts[after[x]])) is not None:
                            note(x, r >> SHIFT)
        whole = np.frombuffer(parts, np.int32)
        return array("i", whole[whole >= 0].tobytes())

    def split(self, raw: str) -> list[str]:
        """The words of a stretch without white space."""
        if raw.isascii():
            low = raw.lower()
        else:
            low = unicodedata.normalize("NFC", raw).translate(_LOWER).lower()
            if max(low) > "\u024f":
                return self.words.findall(low)
        if low.isalpha():  # in these scripts the same as the pattern's letters
            return [low]
        if low[-1] in _SIMPLE and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.words.findall(low)

    def plain(self, text: str) -> bytes:
        stretches = text.split() if not self.odd.search(text) else [s for s in self.space.split(text) if s]
        return b"".join(map(self.ids.__getitem__, stretches))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text or not self.specials:
            return self.plain(text)
        ids, at = [], 0
        for m in self.specials.finditer(text):
            ids += [self.plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*ids, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The pieces of ids in bytes, joined by blanks."""
        return " ".join(map(self.table.__getitem__, array("I", ids)))


def make_kernel(real: bool, packed: bool):
    def make(blob: bytes):
        codec = kept_model((__name__, hashlib.sha256(blob).digest()), lambda: Codec(blob))

        def kernel(texts: list[str | None]) -> list[list]:
            rows = [codec.encode(t) for t in texts]
            decoded = map(codec.decode, rows)
            if real:
                decoded = list(decoded)
            out = [
                [len(i) // 4 for i in rows],
                [hashlib.sha256(i).hexdigest() for i in rows],
                [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded],
            ]
            if packed:
                out.append(rows)
            if real:
                out += [[list(array("I", i)) for i in rows], decoded]
            return out

        return kernel

    return make


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, real: bool = True, packed: bool = False) -> DataFrame:
    """Appends n_tokens and the digests and, with `packed`, the ids as bytes or, with `real`, as numbers and the decoded text; one pass without a shuffle.

    `vocabulary` is the path of the file, read on the driver and broadcast (under 2 MB for the public one).
    """
    with open(vocabulary, "rb") as f:
        blob = f.read()
    fields = [*FIELDS, *[PACKED] * packed, *REAL_FIELDS[len(FIELDS) :] * real]
    return annotate(docs, [text_col], make_kernel(real, packed), fields, payload=blob, keep=keep)
