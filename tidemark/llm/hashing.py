"""Words of many texts at once, as 64-bit rolling hashes in numpy."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import process_cache, ship

ship(__name__)

#: Bytes hashed in one go; cuts fall on separators, and a longer word is hashed piece by piece.
WINDOW = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    store = process_cache()
    have = store.get("powers")
    if have is None or len(have[0]) < n:
        n = max(n, WINDOW + 64)
        up, down = (np.full(n, b, np.uint64) for b in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        have = store["powers"] = (np.cumprod(up), np.cumprod(down), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)))
    return have


def separators(chars: bytes) -> np.ndarray:
    """A table of 256 flags, true at the given bytes."""
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


#: The bytes of [\x20\x09-\x0D].
BLANKS = bytes([32, 9, 10, 11, 12, 13])


def _long_word(data: np.ndarray, blank: np.ndarray, at: int, prefixes: tuple[int, ...]) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """End, hash and prefix hashes of a word longer than a window, as hash_words gives them for others."""
    up, _, values = _powers(WINDOW)
    step, shift = pow(_BASE, WINDOW, 1 << 64), 1
    total, first, to = 0, [], at
    while True:
        part = data[to : to + WINDOW]
        cut = np.flatnonzero(blank[part])
        part = part[: int(cut[0])] if len(cut) else part
        terms = values[part] * up[: len(part)]
        if to == at:
            first = [mix(np.array([terms[:k].sum(dtype=np.uint64)]) + np.uint64(k)) for k in prefixes]
        total = (total + int(terms.sum(dtype=np.uint64)) * shift) % (1 << 64)
        to += len(part)
        if len(cut) or to >= len(data):
            return to, mix(np.array([total], np.uint64)), first
        shift = shift * step % (1 << 64)


def hash_words(data: np.ndarray, blank: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Begins, ends and hashes of the maximal runs of bytes that aren't blank.

    For each length in `prefixes` an array of the hashes of the runs' first
    bytes follows; it is 0 where the run is shorter.
    """
    begins, ends, hashes = [], [], []
    more: list[list[np.ndarray]] = [[] for _ in prefixes]
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + WINDOW)
        if to < n:  # back to a separator, or on to the next
            cut = np.flatnonzero(blank[data[at:to]])
            if not len(cut):
                end, h, first = _long_word(data, blank, at, prefixes)
                begins.append(np.array([at]))
                ends.append(np.array([end]))
                hashes.append(h)
                for own, p in zip(more, first):
                    own.append(p)
                at = end
                continue
            to = at + int(cut[-1]) + 1
        part = data[at:to]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~blank[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        b, e = edge[::2], edge[1::2]
        if len(b):
            up, down, values = _powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=total[1:])
            begins.append(b + at)
            ends.append(e + at)
            hashes.append(mix((total[e] - total[b]) * down[b]))
            for k, own in zip(prefixes, more):
                p = mix((total[np.minimum(b + k, len(part))] - total[b]) * down[b] + np.uint64(k))
                own.append(np.where(e - b >= k, p, np.uint64(0)))
        at = to
    if not begins:
        none = np.zeros(0, np.int64)
        return none, none, *(np.zeros(0, np.uint64) for _ in range(1 + len(prefixes)))
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(hashes), *map(np.concatenate, more)


def join_texts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of texts, a newline after each, and the place where each begins (and the buffer's end)."""
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts
