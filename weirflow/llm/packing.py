"""Pattern packing by non-negative least squares (operator 5).

1. Every document is tokenised where it lies and cut into pieces of at most ``WINDOW`` tokens; only the pieces'
   lengths and checksums are kept.
2. The histogram of lengths, at most ``WINDOW`` numbers whatever the corpus, is fitted by patterns of at most
   ``PARTS`` pieces: x >= 0 minimising |A x - h|, repeat counts rounded down.
3. Pieces that no pattern takes are packed into the gaps, longest first into the tightest gap (best fit), and into
   new sequences where none is wide enough. Both steps work on runs of equal sequences, so the plan, a list of
   intervals (length, first rank, count, first sequence, offset), is bounded by ``WINDOW`` too and not by the corpus.
4. Each piece gets its rank among those of its length: the number within (length, salt) from a window, plus the
   start of its salt from the histogram. A length has a salt for every ``SALT_ROWS`` of its pieces.
   The rank is looked up in the plan.

Defined cases: a null or empty text has the one token that ends a document; equal lengths are ranked by salt, id and
piece, so repeated rows get places of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.llm.common import materialize, read_table
from weirflow.llm.spans import SPACES, Lookup, gathered, slices, span_hashes, spans

WINDOW = 4096
END_ID = 1
#: Patterns: the window is divided in GRID steps, and a pattern has at most PARTS pieces.
GRID, PARTS = 32, 4
#: Distinct chunks whose ids a worker keeps; chunks tokenised at once.
CACHE, AT_ONCE = 400_000, 20_000
#: Pieces for each salt: the most that are ranked in one group.
SALT_ROWS = 1_000_000
#: Longest run of punctuation taken from a chunk's end.
STOPS = 4

#: Words that normalising leaves as they are and pre-tokenising leaves whole.
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: How the byte-level alphabet shows a byte: itself where that is a visible Latin-1 character, else one from U+0100 on.
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[SPACES] = False
_STOP = np.zeros(256, bool)
_STOP[list(b'.,;:!?#*"()[]{}-_~$%&@=+/')] = True


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTokenizer:
    """Ids of whole texts, by way of their chunks between ASCII white space, which this tokenizer never joins.

    Chunks are told apart by 64-bit hashes; those met for the first time in a slice of texts are tokenised together.
    A run of punctuation at the end of a chunk, after a letter, is a chunk of its own: the tokenizer parts there too.
    When too many are known, those that the last slice had stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.divider = self.tokenizer.encode("0", add_special_tokens=False).ids[0]
        self.keep(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))

    def keep(self, keys: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Known chunks: ``keys`` sorted, with their ids one after the other."""
        self.look, self.length, self.ids_of = Lookup(keys), np.append(length, 0), ids
        self.start = np.cumsum(self.length) - self.length

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def tokenise(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after the other, and the number of each.

        Runs of plain small letters go to the merges at once, as bytes' letters; others without a 0 together, with
        zeros between them: only these give the zero's id.
        """
        others = [c for c in chunks if "0" not in c and not _LETTERS(c)]
        parts: dict[str, list[int]] = {}
        for low in range(0, len(others), AT_ONCE):
            some = others[low : low + AT_ONCE]
            ids = self.whole(" 0 ".join(some))
            ends = np.append(np.flatnonzero(ids == self.divider), len(ids)).tolist()
            ids, start = ids.tolist(), 0
            for chunk, end in zip(some, ends, strict=True):
                parts[chunk] = ids[start:end]
                start = end + 1
        merge, flat, lengths = self.tokenizer.model.tokenize, [], []
        for c in chunks:
            if c in parts:
                found = parts[c]
            elif "0" in c:
                found = self.whole(c).tolist()
            else:
                found = [t.id for t in merge(c if c.isascii() else c.encode().decode("latin-1").translate(_SHOWN))]
            flat += found
            lengths.append(len(found))
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def taken(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of known chunks ``ids`` stand, one after the other, and the chunk each belongs to."""
        owner = np.repeat(np.arange(len(ids)), lengths)
        return np.arange(len(owner)) + np.repeat(self.start[ids] - (np.cumsum(lengths) - lengths), lengths), owner

    def learn(self, keys: np.ndarray, chunks: list[str], used: np.ndarray) -> None:
        """Add new chunks; beyond ``CACHE``, of the known ones only those in ``used`` stay."""
        known = np.arange(len(self.look.keys) - 1)
        if len(known) + len(keys) > CACHE:
            known = np.unique(used)
        more, new = self.tokenise(chunks)
        all_keys, lengths = np.concatenate([self.look.keys[known], keys]), np.concatenate([self.length[known], new])
        starts, data = np.concatenate([self.start[known], len(self.ids_of) + np.cumsum(new) - new]), self.ids_of
        order = np.argsort(all_keys)
        lengths, starts = lengths[order], starts[order]
        at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        self.keep(all_keys[order], np.concatenate([data, more])[at], lengths)

    def odd(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts to tokenise whole: with combining marks, controls between space and text, letters lower-cased by context, or what may be a special token."""
        found = (raw == 0xCC) | (raw == 0xCD) | ((raw >= 0x1C) & (raw <= 0x1F))
        for first, second in (b"\xc4\xb0", b"\xce\xa3", b"\xc2\x85", b"<|"):
            at = np.flatnonzero(raw[:-1] == first)
            found[at[raw[at + 1] == second]] = True
        return np.unique(np.searchsorted(offsets, np.flatnonzero(found), "right") - 1)

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all texts of a slice, each followed by ``END_ID``, and the number of each text's."""
        texts = len(offsets) - 1
        odd = self.odd(raw, offsets)
        low = _LOWER[raw]
        begin, end, text = spans(_INSIDE[low].view(np.uint8), offsets)
        if len(odd):
            plain = ~np.isin(text, odd)
            begin, end, text = begin[plain], end[plain], text[plain]
        stem = end.copy()
        for _ in range(STOPS):
            stem -= (stem > begin + 1) & _STOP[low[stem - 1]]
        last = low[stem - 1]
        stem = np.where((last >= 97) & (last <= 122), stem, end)
        parted = np.flatnonzero(stem < end)
        begin, end, text = np.insert(begin, parted + 1, stem[parted]), np.insert(stem, parted + 1, end[parted]), np.insert(text, parted + 1, text[parted])

        keys = span_hashes(low, begin, end)
        at = self.look(keys)
        if (at < 0).any():
            new, first = np.unique(keys[at < 0], return_index=True)
            first = np.flatnonzero(at < 0)[first]
            self.learn(new, gathered(low, begin[first], end[first]).to_pylist(), at[at >= 0])
            at = self.look(keys)
        lengths = self.length[at]
        whole = {int(k): self.whole(raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")) for k in odd}
        own = np.bincount(text, lengths, texts).astype(np.int64)
        total = own + 1
        for k, found in whole.items():
            total[k] = len(found) + 1
        ends = np.cumsum(total)
        out = np.full(ends[-1], END_ID, np.uint32)
        source, owner = self.taken(at, lengths)
        # a chunk's ids move by what stands before its text beyond the chunks' own ids
        out[np.arange(len(source)) + (ends - total - (np.cumsum(own) - own))[text][owner]] = self.ids_of[source]
        for k, found in whole.items():
            out[ends[k] - total[k] : ends[k] - 1] = found
        return out, total


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker, which Spark uses for many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = worker_tokenizer(path)
        for batch in batches:
            for low, high, raw, offsets in slices(batch.column(1)):
                ids, total = chunked.ids(raw, offsets)
                count = -(-total // window)
                text = np.repeat(np.arange(high - low), count)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(window, total[text] - piece * window)
                ends = np.cumsum(length)
                data = memoryview(ids.tobytes())
                checks = [zlib.crc32(data[4 * b : 4 * e]) for b, e in zip((ends - length).tolist(), ends.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(low + text)), *(pa.array(c, t) for c, t in ((piece, pa.int32()), (piece * window, pa.int64()), (length, pa.int64()), (checks, pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- the plan, on the histogram


def patterns(grid: int, parts: int) -> np.ndarray:
    """All ways to fill ``grid`` steps with at most ``parts`` pieces: a matrix of piece sizes by patterns."""
    found: list[list[int]] = []

    def extend(left: int, largest: int, chosen: list[int]) -> None:
        if not left:
            found.append(chosen)
        elif len(chosen) < parts:
            for size in range(min(left, largest), 0, -1):
                extend(left - size, size, [*chosen, size])

    extend(grid, grid, [])
    matrix = np.zeros((grid, len(found)))
    for k, chosen in enumerate(found):
        for size in chosen:
            matrix[size - 1, k] += 1
    return matrix


def nnls(a: np.ndarray, b: np.ndarray, most: int = 300) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set: add the steepest column, drop what turns negative."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(most):
        slope = np.where(free, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            wanted = np.zeros_like(x)
            wanted[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (wanted <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - wanted[low], 1e-300))
            x += step * (wanted - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                wanted = x
                break
        x = wanted
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, grid: int = GRID, parts: int = PARTS) -> tuple[np.ndarray, int]:
    """Intervals (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    intervals: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of equal sequences (first, count)
    sequences = 0
    step = -(-window // grid)

    def put(length: int, count: int, first: int, offset: int) -> None:
        intervals.append((length, ranks[length], count, first, offset))
        ranks[length] += count
        left[length] -= count

    # whole patterns: repeat counts by least squares over the grid, lengths rounded up to it
    h = np.zeros(grid)
    by_size: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        h[-(-n // step) - 1] += left[n]
        by_size.setdefault(-(-n // step), []).append(n)
    a = patterns(grid, parts)
    repeats = np.floor(nnls(a, h)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        sizes = [size for size in range(grid, 0, -1) for _ in range(int(a[size - 1, k]))]
        todo = int(repeats[k])
        while todo > 0:
            chosen: list[int] = []
            for size in sizes:
                chosen.append(next((n for n in by_size.get(size, []) if left[n] > chosen.count(n)), 0))
            if not all(chosen):
                break
            runs = min(todo, *(left[n] // chosen.count(n) for n in chosen))
            at = 0
            for n in chosen:
                put(n, runs, sequences, at)
                at += n
            if at < window:
                gaps.setdefault(window - at, []).append((sequences, runs))
            sequences += runs
            todo -= runs
            for size in set(sizes):
                while by_size.get(size) and not left[by_size[size][0]]:
                    by_size[size].pop(0)

    # the rest: longest first, into the tightest gap
    for n in sorted(left, reverse=True):
        while left[n]:
            free = min((g for g in gaps if g >= n), default=None)
            if free is None:
                each = window // n
                whole, over = divmod(left[n], each)
                for count, copies in ((whole, each), (1 if over else 0, over)):
                    if count:
                        for c in range(copies):
                            put(n, count, sequences, c * n)
                        if copies * n < window:
                            gaps.setdefault(window - copies * n, []).append((sequences, count))
                        sequences += count
                continue
            runs = gaps.pop(free)
            while runs and left[n]:
                first, count = runs.pop()
                used = min(count, left[n])
                put(n, used, first, window - free)
                if free > n:
                    gaps.setdefault(free - n, []).append((first, used))
                if used < count:
                    runs.append((first + used, count - used))
            if runs:
                gaps[free] = runs
    return np.array(sorted(intervals), np.int64).reshape(-1, 5), sequences


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), which must be a stored table."""
    spark = found.sparkSession
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # window rows at most
    groups = np.zeros(window + 2, np.int64)
    for length, count in histogram.items():
        groups[length] = -(-count // SALT_ROWS)
    first = np.cumsum(groups) - groups
    salts = spark.createDataFrame([(length, int(groups[length])) for length in histogram], "length bigint, salts bigint")
    salted = found.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").count().toPandas()  # a row for each length and each SALT_ROWS pieces
    sizes = np.zeros(first[-1], np.int64)
    sizes[first[counts["length"]] + counts["salt"].to_numpy()] = counts["count"]
    before = np.cumsum(sizes) - sizes
    base = before - np.repeat(before[np.minimum(first, len(sizes) - 1)] if len(sizes) else first, groups)
    intervals, _ = plan(histogram, window)
    sent = spark.sparkContext.broadcast((first, base, intervals))
    numbered = salted.withColumn("number", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, intervals = sent.value
        wide = np.int64(1) << np.int64(44)
        keys = intervals[:, 0] * wide + intervals[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = base[first[length] + batch.column("salt").to_numpy()] + batch.column("number").to_numpy() - 1
            row = np.searchsorted(keys, length * wide + rank, "right") - 1
            hit = intervals[row]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], [*names, "sequence_id", "offset"])

    names = found.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return numbered.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Tokenise, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(docs, path or tokenizer_path(), window), "pieces"), window)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
