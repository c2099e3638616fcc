"""Words of many texts at once: where they are in the texts' UTF-8 bytes, and their 64-bit hashes.

A word is a run of bytes of one class, so it never crosses the end of a text. Hashes take eight bytes at a time over
all words of a slice of texts; two different words share a hash once in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from weirflow.llm.common import mix64

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Longer words are hashed one by one.
LONG_WORD = 256
SPACES = [32, 9, 10, 11, 12, 13]

_P = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of at most ``most`` bytes; a null text is empty."""
    if not len(texts):
        return
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def spans(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every run of equal classes other than 0."""
    if not len(classes):
        return (np.empty(0, np.int64),) * 3
    edge = np.empty(len(classes), bool)
    edge[0] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:])
    starts = offsets[:-1]
    edge[starts[starts < len(classes)]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(classes))
    inside = classes[begin] > 0
    begin, end = begin[inside], end[inside]
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between ``begin`` and ``end``."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    length = end - begin
    with np.errstate(over="ignore"):
        out = length.astype(np.uint64) * _P
        out = mix64(out + (words[begin] & _KEEP[np.minimum(length, 8)]) * np.uint64(0xD6E8FEB86659FD93))
        todo = np.flatnonzero((length > 8) & (length <= LONG_WORD))
        at = 8
        while len(todo):
            left = length[todo] - at
            out[todo] = mix64(out[todo] * _P + (words[begin[todo] + at] & _KEEP[np.minimum(left, 8)]))
            todo, at = todo[left > 8], at + 8
    for k in np.flatnonzero(length > LONG_WORD):
        out[k] = int.from_bytes(blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gathered(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings between ``begin`` and ``end``."""
    length = end - begin
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at].tobytes()))


class Lookup:
    """Place of 64-bit keys, evenly spread as hashes are, among sorted distinct ones; -1 where absent."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.longest = int(np.diff(np.append(self.first, len(keys))).max(initial=0))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[wanted >> np.uint64(64 - self.bits)]
        found = np.where(self.keys[at] == wanted, at, -1)
        open_ = np.flatnonzero((self.keys[at] < wanted) & (found < 0))
        last = len(self.keys) - 2
        for step in range(1, self.longest):
            place = np.minimum(at[open_] + step, max(last, 0))
            here = self.keys[place]
            hit = here == wanted[open_]
            found[open_[hit]] = place[hit]
            open_ = open_[here < wanted[open_]]
            if not len(open_):
                break
        if last < 0:
            found[:] = -1
        elif (zero := wanted == 0).any() and self.keys[0] != 0:
            found[zero] = -1
        return found
