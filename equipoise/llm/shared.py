"""What several operators of this package share: the shared folder, word hashing, prefix sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import drop, shared_folder, store  # noqa: F401  for the operators beside this module

#: A word, as every contract of this package counts it.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of the text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*cols: Column | str) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums of columns within each group, spread over buckets.

    Rows of a group are taken bucket by bucket, and within a bucket by `order`. `sums` maps each new
    column to the SQL expression it adds up. No task holds a group: each sorts single buckets, and what
    a bucket starts from comes from one small row for each (group, bucket). Group columns must not be null.
    """
    part = Window.partitionBy(*group, bucket)
    each = df.groupBy(*group, bucket).agg(*[F.sum(F.expr(e)).alias(f"__t_{c}") for c, e in sums.items()])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col(bucket).alias("__b"), *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__s_{c}") for c in sums])
    within = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select("*", *[F.coalesce(F.sum(F.expr(e)).over(within), F.lit(0)).alias(c) for c, e in sums.items()])
    same = F.col(bucket) == F.col("__b")
    for g in group:
        same = same & (F.col(g) == F.col(f"__g_{g}"))
    joined = inner.join(starts, same)
    for c in sums:
        joined = joined.withColumn(c, F.col(c) + F.col(f"__s_{c}"))
    return joined.drop("__b", *[f"__g_{g}" for g in group], *[f"__s_{c}" for c in sums])


def numbers(values: list, kind: str) -> Column:
    """A list of numbers as one array literal; a single string on its way to the planner, which folds it."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def buckets(rows: int, least: int, each: int) -> int:
    """As many buckets as keep `each` rows a bucket, `least` at least."""
    return max(least, -(-rows // each))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(64, dtype=np.uint64)
for _i in range(1, 64):
    _POWERS[_i] = np.uint64((int(_POWERS[_i - 1]) * _BASE) % (1 << 64))


def split_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: which belong to words, and where words start and end; words are split at the ASCII white space of WORD."""
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return word, edges[::2], edges[1::2]


def hash_words(raw: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word found by split_words."""
    if not len(lengths):
        return np.empty(0, dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(first, lengths)
    chars = raw[word].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        # a long word starts a new power every 64 bytes, salted by the block it is in
        value = chars * _POWERS[at & 63] * (np.uint64(2) * (at >> 6).astype(np.uint64) + np.uint64(1))
        return mix(np.add.reduceat(value, first) ^ (lengths.astype(np.uint64) << np.uint64(40)))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, in order."""
    raw = np.frombuffer(text, dtype=np.uint8)
    word, starts, ends = split_words(raw)
    return hash_words(raw, word, ends - starts)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles of a text, A-Z lowered; a shorter text is one shingle; none for null or no word."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = word_hashes(text.encode("utf-8", "replace").lower())
    if not len(words):
        return words
    wide = min(width, len(words))
    count = len(words) - wide + 1
    with np.errstate(over="ignore"):
        out = np.full(count, np.uint64(wide), dtype=np.uint64)
        for i in range(wide):
            out = mix(out * np.uint64(_BASE) + words[i : i + count])
    return np.unique(out)
