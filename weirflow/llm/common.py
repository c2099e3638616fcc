"""What the training-data operators share: scratch tables, hot-key joins, word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.stored import materialize, scratch_path, shared_dir

__all__ = ["join_weighted", "materialize", "mix64", "read_table", "scratch_path", "shared_dir", "shingle_set", "word_hashes"]


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key is hot when it has more than this share of the rows, so fewer than 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 1000


def join_weighted(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, which has one row per ``key`` and in ``weight`` the number of left rows with that key.

    Keys with more than ``HOT_SHARE`` of the rows, fewer than 1000 whatever the size of the input, are broadcast, so
    that their rows stay where they are; the rest goes by sort-merge join. Without hot keys nothing is broadcast: each
    broadcast, even of no rows, takes pages and a thread of the driver. A null key matches nothing.
    """
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    least = max(1000, int((total or 0) * HOT_SHARE))
    cold = right.filter(F.col(weight) <= least).hint("merge")
    if (most or 0) <= least:
        return left.join(cold, key, how)
    hot = right.filter(F.col(weight) > least)
    is_hot = F.col("_hot").isNotNull()
    marked = left.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    near = marked.filter(is_hot).drop("_hot").join(F.broadcast(hot), key)
    far = marked.filter(~is_hot | is_hot.isNull()).drop("_hot").join(cold, key, how)
    return near.unionByName(far)


# ---------------------------------------------------------------- hashing of words, a whole batch at a time

_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longest run of bytes hashed at once; the sums of a word that is longer are taken piece by piece.
_POW_LEN = 1 << 16
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_POW_LEN, 0xD6E8FEB86659FD93, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^ \\t-\\r]+`` of UTF-8 bytes, A-Z lower-cased, in order."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))[: len(raw) - begin[0]] if begin[0] == 0 else None
    if place is None:
        raw, inside = raw[begin[0] :], inside[begin[0] :]
        end, begin = end - begin[0], begin - begin[0]
        place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    with np.errstate(over="ignore"):
        part = _BYTE[raw] * _POW[place % _POW_LEN] * (np.uint64(1) + (place // _POW_LEN).astype(np.uint64) * np.uint64(2))
        part[~inside] = 0
        total = np.add.reduceat(part, begin)
        return mix64(total + (end - begin).astype(np.uint64) * _P)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a text; one of all its words where it has fewer; none without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width if width < n else 0, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out * _P + words[i : len(words) - width + 1 + i])
    return np.unique(out)
