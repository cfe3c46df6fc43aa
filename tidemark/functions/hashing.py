"""Hashes of keys in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS, _PROBES, _FLIP = 8192, 10, 0xBC9F1D34
MAX_TS = 2**63 - 1


def fnv1a32(key: Column) -> Column:
    """The 32-bit FNV-1a hash of a key's bytes, unsigned."""
    data = key.cast("binary")
    steps = F.sequence(F.lit(0), F.octet_length(key) - 1)
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("long")
    prime = F.lit(16777619).cast("long")
    mixed = F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * prime).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.octet_length(key) > 0, mixed).when(key.isNotNull(), F.lit(2166136261).cast("long"))


def bloom_positions(key: Column) -> Column:
    """The bits of a file's filter that a key sets: double hashing in 32 bits. The key is hashed once."""
    place = lambda h, i: F.pmod((h + F.lit(i) * h.bitwiseXOR(F.lit(_FLIP))).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(_BITS))
    return F.transform(F.array(fnv1a32(key)), lambda h: F.array(*(place(h, i) for i in range(_PROBES))))[0]


def filter_bits(keys: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """The filter of each group (file, run) of keys: `bits`, the positions that any of its keys sets, at most 8192, in order."""
    set_ = keys.select(*by, F.explode(bloom_positions(F.col(key))).alias("bit")).distinct()
    return set_.groupBy(*by).agg(F.array_sort(F.collect_list("bit")).alias("bits"))


def may_contain(bits: Column, key: Column) -> Column:
    """Whether a filter lets a key through: all of the key's bits are set. A key that was put in always passes.

    The whole filter is looked through for each key; `filter_words` and `passes` are for many keys of one filter.
    """
    return F.size(F.array_except(bloom_positions(key), bits)) == 0


def filter_words(keys: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """The filter of each group as `filter_bits`, but packed: `words`, 128 of 64 bits, of which a lookup reads ten however many bits are set."""
    set_ = keys.select(*by, F.explode(bloom_positions(F.col(key))).alias("bit"))
    words = set_.groupBy(*by, F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("own"))
    held = words.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "own")))).alias("held"))  # 128 at most
    every = F.sequence(F.lit(0).cast("long"), F.lit(_BITS // 64 - 1).cast("long"))
    return held.select(*by, F.transform(every, lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long"))).alias("words"))


def passes(words: Column, positions: Column) -> Column:
    """Whether a packed filter lets a key of these `bloom_positions` through, as `may_contain`."""
    is_set = lambda p: F.getbit(words[F.shiftright(p, 6).cast("int")], p.bitwiseAND(F.lit(63)).cast("int")) == 1
    return F.when(words.isNotNull() & positions.isNotNull(), F.coalesce(F.forall(positions, is_set), F.lit(False)))


def fnv1a32_of(key: bytes) -> int:
    """The same hash of one key, for writers of files."""
    h = 2166136261
    for b in key:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def bloom_bits_of(key: bytes) -> list[int]:
    first = fnv1a32_of(key)
    return [(first + i * (first ^ _FLIP) & 0xFFFFFFFF) % _BITS for i in range(_PROBES)]


def inverted(ts: Column) -> Column:
    """Timestamps so that later ones sort first; its own inverse."""
    return F.lit(MAX_TS) - ts
