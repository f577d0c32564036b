"""Distances and quantisation of array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def cosine_distance(a: Column, b: Column, zero: float = 2.0) -> Column:
    return F.coalesce(1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(zero))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))))


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def int8(a: Column, low: float, high: float) -> Column:
    """Levels -127 to 127 over [low, high]."""
    scale = (high - low) / 254 or 1.0
    return F.transform(a.cast("array<double>"), lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor((v - low) / scale - 127 + 0.5))).cast("int"))


def from_int8(a: Column, low: float, high: float) -> Column:
    scale = (high - low) / 254 or 1.0
    return F.transform(a, lambda q: (q + 127) * scale + low)


def binary_words(a: Column, dim: int) -> Column:
    """One bit per component, set where it is positive, in 32-bit words held as longs."""
    word = lambda k: F.aggregate(
        F.slice(a, k * 32 + 1, 32), F.lit(0).cast("long"), lambda acc, v: acc * 2 + (v > 0).cast("long"))
    return F.array(*[word(k) for k in range(-(-dim // 32))])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def from_binary_words(words: Column, dim: int) -> Column:
    """1.0 for each set bit and -1.0 for the others."""
    def bit(k: int) -> Column:
        width = min(32, dim - k // 32 * 32)  # the last word may be short
        return F.shiftright(F.get(words, k // 32), width - 1 - k % 32).bitwiseAND(F.lit(1).cast("long"))

    return F.array(*[F.when(bit(k) == 1, 1.0).otherwise(-1.0) for k in range(dim)])


def value_range(rows, vector: str):
    """One row (low, high) of all components: what ``int8`` needs."""
    v = F.col(vector).cast("array<double>")
    return rows.agg(F.min(F.array_min(v)).alias("low"), F.max(F.array_max(v)).alias("high"))


_OFFSET, _PRIME, _MASK = 2166136261, 16777619, 2**32 - 1


def _units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    h = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(h) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _fnv_step(h: Column, c: Column) -> Column:
    return (h.bitwiseXOR(c) * _PRIME).bitwiseAND(F.lit(_MASK))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units."""
    return F.aggregate(_units(text), F.lit(_OFFSET).cast("long"), _fnv_step)


def fnv1a_pair(text: Column) -> Column:
    """Struct of h1, and of h2 that also folds its upper half in at each unit."""
    start = F.struct(F.lit(_OFFSET).cast("long").alias("h1"), F.lit(_OFFSET).cast("long").alias("h2"))

    def step(h: Column, c: Column) -> Column:
        two = _fnv_step(h["h2"], c)
        return F.struct(_fnv_step(h["h1"], c).alias("h1"), two.bitwiseXOR(F.shiftright(two, 16)).alias("h2"))

    return F.aggregate(_units(text), start, step)


def hash_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def shard_of(text: Column, shards: int = 256) -> Column:
    return F.pmod(fnv1a(text), F.lit(shards))
