"""N-gram Jaccard join by token-combination prefixes (operator 10), exact.

A document is its set of word n-grams ("tokens", as 64-bit hashes). Two link when |A and B| / |A or B| >= threshold.

1. One row per distinct set goes on (its smallest id); copies follow it at the end.
2. Tokens are classed by the number of documents that have them. All tokens are counted, as 32-bit fingerprints in
   packed shards; what is counted more than once goes into a table of fixed size (``CELLS`` cells of two bits).
   Class 0 are tokens that one document has, 1 to 3 ever more frequent ones. A cell that two tokens share only makes
   a token seem more frequent than it is; from some 10^9 tokens on most cells are taken, and nearly none is of class 0.
3. Tokens are put in order by class and hash. Linked sets of at least n tokens share at least m <= ceil(t n) tokens in
   their prefixes of length |A| - ceil(t |A|) + m. Frequent tokens are dealt by hash over G groups; with
   m = (k - 1) G + 1 the shared tokens are one that is not frequent, or k frequent ones of one group. So single tokens
   of class 1 are indexed; k = 3: of a group's frequent tokens pairs with one of class 2, and triples of class 3; sets too
   small for that take k = 2, pairs of frequent tokens, or k = 1. G grows with the size, so that keys are few for each
   token of a prefix at every size. Linked sets must agree on k and G: these go by levels of size, each ``LEVEL``
   times the one before, and a set takes part in its level and in that of the smallest set it may link with.
   Tokens of class 0 link nothing and are not indexed.
   The keys go to shards as packed bytes, some four for a key and four for its document and size. A shard gives on only
   what is shared, as lists of documents, cut where sizes are too far apart, and the same list once. So it doesn't
   matter how many keys have one document, which is most of them where the table is full. Documents that may be copies
   wait until it is known which are.
4. Sets in one list are compared by size and by parity bitmaps (each token flips one of as many bits as there are
   tokens, at least, and ``BITS``), which bound the size of their difference from below, so no link is lost. Lists
   with one smallest id are compared in one task, to which a bitmap goes once. A list, cut in blocks of ``BLOCK_SETS``
   where it is large, yields a forest of the pairs that may link, never all pairs; the components of these forests are
   the canopies.
5. A canopy is cut in blocks of ``BLOCK_TOKENS`` tokens, and each pair of blocks is one group that counts overlaps by an
   inverted list and yields a forest of the links it finds. Components of these links are the result. Any two sets that
   link are in one canopy and in one pair of its blocks. Only texts of sets in canopies are shuffled, and those few whose
   ids look like theirs to a table of ``MARKS`` bits.

Defined cases: null texts and texts without words have empty sets and link with nothing, not even with each other;
texts with fewer than n words have one token, all their words; repeated rows are copies; null ids are not linked; an
empty table gives no rows; further columns are kept by ``keep_one``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import join_weighted, materialize, mix64, read_table, shingle_set
from weirflow.llm.components import connected_components

CELLS = 1 << 26
#: Documents from which a token is of class 2, and of class 3: these are the frequent ones.
CLASS_2, CLASS_3 = 64, 1024
#: The step between levels of size, and about how many tokens of a prefix share a group.
LEVEL, GROUP = 1.5, 4
BITS = 512
BLOCK_SETS = 1024
BLOCK_TOKENS = 400_000
FLUSH = 1_000_000
#: Bits of an index key that count: what two keys share by chance is compared in vain. Bits of a table of ids, and its parts.
KEY_BITS = 48
MARKS, MARK_PARTS = 1 << 26, 64


# ---------------------------------------------------------------- counting of tokens


def fingerprints(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def token_table(docs: DataFrame, words: int, shards: int) -> DataFrame:
    """One pass over the texts: rows (doc_id, n, set_hash, set_check) of documents, and (shard, prints) of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, held, waiting = [], [], [], [], 0
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), words)
                n.append(len(tokens))
                with np.errstate(over="ignore"):
                    one.append(int(mix64(tokens).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                held.append(tokens)
                waiting += len(tokens)
                if waiting > FLUSH:
                    yield counted(held)
                    held, waiting = [], 0
            nothing = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary()), pa.nulls(nothing, pa.int64())], names
            )
            if waiting:
                yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.sort(fingerprints(np.concatenate(held)))
        ends = np.searchsorted(prints, np.arange(1, shards + 1, dtype=np.uint64) * np.uint64((1 << 32) // shards))
        rows, start = [], 0
        for s, end in enumerate(ends.tolist()):
            if end > start:
                part = prints[start:end]
                gaps = np.diff(part, prepend=part[0])
                rows.append((s, np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), int(part[0])))
            start = end
        k = len(rows)
        return pa.RecordBatch.from_arrays(
            [*[pa.nulls(k, pa.int64())] * 4, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names
        )

    names = ["doc_id", "n", "set_hash", "set_check", "shard", "gaps", "low"]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, set_hash bigint, set_check bigint, shard int, gaps binary, low bigint")
    return materialize(rows, "tokens")


def token_classes(table: DataFrame, shards: int) -> np.ndarray:
    """Two bits a cell for every fingerprint: CELLS // 4 bytes, whatever the corpus; each shard makes its part.

    The parts are sent to the driver packed: most cells of a small corpus are empty.
    """
    width = CELLS // shards

    def count(key: tuple, group: pa.Table) -> pa.Table:
        parts = []
        for gaps, low in zip(group["gaps"].to_pylist(), group["low"].to_pylist(), strict=True):
            steps = np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            parts.append(np.cumsum(steps, dtype=np.uint32) + np.uint32(low))
        prints, n = np.unique(np.concatenate(parts), return_counts=True)
        prints, n = prints[n > 1], n[n > 1]
        level = np.zeros(width, np.uint8)
        np.maximum.at(level, cells_of(prints) - key[0].as_py() * width, (1 + (n >= CLASS_2) + (n >= CLASS_3)).astype(np.uint8))
        four = level.reshape(-1, 4)
        bits = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(bits, 1)], pa.binary())})

    rows = table.filter(F.col("shard").isNotNull()).select("shard", "gaps", "low").groupBy("shard").applyInArrow(count, "shard int, bits binary")
    found = np.zeros(CELLS // 4, np.uint8)
    for r in materialize(rows, "token-classes").toLocalIterator():  # CELLS // 4 bytes in all, and less packed
        found[r["shard"] * width // 4 : (r["shard"] + 1) * width // 4] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return found


def cells_of(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int64)


def class_of(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    cell = cells_of(fingerprints(tokens))
    return (classes[cell >> 2] >> ((cell & 3) << 1).astype(np.uint8)) & 3


# ---------------------------------------------------------------- index keys


class Levels:
    """By level of size: the least size, k (tokens in a combination) and the number of groups."""

    def __init__(self, threshold: Fraction):
        self.threshold, step = threshold, max(1 / threshold, LEVEL)
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, math.ceil(low[-1] * step)))
        self.low = np.array(low, np.int64)
        self.groups, self.k = [], []
        for n in low:
            shared, groups = math.ceil(threshold * n), max(1, int((1 - threshold) * n / GROUP))
            k = next(k for k in (3, 2, 1) if (k - 1) * groups + 1 <= shared or k == 1)
            self.groups.append(groups)
            self.k.append(k)

    def of(self, size: int) -> list[int]:
        """The levels in which a set takes part."""
        return sorted({int(np.searchsorted(self.low, n, "right")) - 1 for n in (size, math.ceil(self.threshold * size))})


def combinations(group: np.ndarray, token: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places of the first tokens, and hashes, of all k tokens of one group, for k of 2 or 3; rows are sorted by group and token.

    Pairs of tokens that both are marked in ``skip`` are left out.
    """
    at, keys = [], []
    p = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for d in range(1, len(group)):
            i = np.flatnonzero(group[d:] == group[:-d])
            if not len(i):
                break
            if skip is not None:
                i = i[~(skip[i] & skip[i + d])]
            two = mix64(token[i] * p + token[i + d])
            if k == 2:
                at.append(i)
                keys.append(two)
                continue
            e = d + 1
            while True:
                more = i + e < len(group)
                i, two = i[more], two[more]
                more = group[i + e] == group[i]
                i, two = i[more], two[more]
                if not len(i):
                    break
                at.append(i)
                keys.append(mix64(two * p + token[i + e]))
                e += 1
    return at, keys


def index_keys(sets: list[np.ndarray], classes: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the index keys of some sets, sorted by set."""
    owners, keys, frequent = [], [], []
    for number, tokens in enumerate(sets):
        if not len(tokens):
            continue
        order = level_of = None
        for level in levels.of(len(tokens)):
            k, groups = levels.k[level], levels.groups[level]
            if order is None:
                level_of = class_of(tokens, classes)
                order = np.lexsort((tokens, level_of))
            width = min(len(tokens), len(tokens) - math.ceil(levels.threshold * len(tokens)) + (k - 1) * groups + 1)
            prefix = tokens[order[:width]]
            of = level_of[order[:width]]
            single = prefix[of == 1] if k > 1 else prefix[of > 0]
            owners.append(np.full(len(single), number))
            keys.append(single)
            if k > 1 and (of > 1).sum() > 1:
                token = prefix[of > 1]
                salt = np.uint64(2 * level + 1) * np.uint64(0xD6E8FEB86659FD93 >> 8)
                group = (mix64(token ^ salt) % np.uint64(groups)).astype(np.int64)
                frequent.append((np.full(len(token), number), np.full(len(token), level), group, token, of[of > 1] if k == 3 else np.full(len(token), 2, of.dtype)))
    if frequent:
        number, level, group, token, of = (np.concatenate(x) for x in zip(*frequent, strict=True))
        order = np.lexsort((token, group, level, number))
        number, level, group, token, of = (x[order] for x in (number, level, group, token, of))
        own = np.cumsum(np.append(0, (np.diff(number) != 0) | (np.diff(level) != 0) | (np.diff(group) != 0)))
        rare = np.flatnonzero(of == 2)
        both, three = np.flatnonzero(np.isin(own, own[rare])), np.flatnonzero(of == 3)
        for chosen, k, skip in ((both, 2, of[both] == 3), (three, 3, None)):
            for at, key in zip(*combinations(own[chosen], token[chosen], k, skip), strict=True):
                first = chosen[at]
                owners.append(number[first])
                keys.append(mix64(key ^ level[first].astype(np.uint64)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner, key = np.concatenate(owners).astype(np.int64), np.concatenate(keys)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new]


def bitmap(tokens: np.ndarray) -> bytes:
    """Each token flips a bit: two sets' bitmaps differ in no more bits than the sets in tokens.

    The bits are a power of two, BITS or the number of tokens at least; of fewer bits, halves are flipped together.
    """
    bits = max(BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


# ---------------------------------------------------------------- tables of ids


def mark_of() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))


def marks(ids: DataFrame) -> np.ndarray:
    """MARKS bits, with those set that ``mark_of`` gives for the ids (doc_id); sent to the driver packed."""
    width = MARKS // MARK_PARTS

    def mark(key: tuple, group: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        bits[group["mark"].to_numpy() % width] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())})

    found = np.zeros(MARKS // 8, np.uint8)
    for r in ids.select(mark_of().alias("mark")).groupBy(F.expr(f"mark DIV {width}").alias("part")).applyInArrow(mark, "part bigint, bits binary").toLocalIterator():
        found[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return found


def marked(mark: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (table[mark >> 3] >> (mark & 7).astype(np.uint8) & 1).astype(bool)


def texts_of(docs: DataFrame, table: Broadcast) -> DataFrame:
    """(doc_id, text) of the documents marked in ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(marked(batch["mark"].to_numpy(), table.value)))

    return docs.select("doc_id", "text", mark_of().alias("mark")).mapInArrow(run, "doc_id bigint, text string")


# ---------------------------------------------------------------- index


def packed(values: np.ndarray) -> bytes:
    """64-bit values, byte by byte, the lowest of all first; as many as the largest value needs."""
    most = max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[:most]).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), np.uint8)
    planes[: len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


INDEX = "doc_id bigint, n bigint, bits binary, shard int, uses bigint, low bigint, gaps binary, least bigint, owners binary, sizes binary"


def index_rows(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}
    size = len(next(iter(columns.values())))
    names = [x.split(" ") for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[x], kinds[kind]) if x in columns else pa.nulls(size, kinds[kind]) for x, kind in names], [x for x, _ in names])


def key_rows(docs: np.ndarray, sizes: np.ndarray, keys: np.ndarray, shards: int) -> pa.RecordBatch:
    """Keys with their documents and these's sizes, a row for each shard: a shard has the keys of a range."""
    order = np.argsort(keys, kind="stable")
    docs, sizes, keys = docs[order], sizes[order], keys[order]
    ends = np.searchsorted(keys, np.arange(1, shards + 1, dtype=np.uint64) * np.uint64((1 << KEY_BITS) // shards))
    rows: dict[str, list] = {x: [] for x in ("shard", "uses", "low", "gaps", "least", "owners", "sizes")}
    start = 0
    for s, end in enumerate(ends.tolist()):
        if end > start:
            part, own = keys[start:end], docs[start:end]
            least = own.min()
            values = (s, end - start, int(part[0]), packed(np.diff(part, prepend=part[0])), int(least), packed((own - least).view(np.uint64)), packed(sizes[start:end].view(np.uint64)))
            for x, value in zip(rows, values, strict=True):
                rows[x].append(value)
        start = end
    return index_rows(rows)


def index(docs: DataFrame, words: int, classes: Broadcast, threshold: Fraction, copies: Broadcast, shards: int) -> DataFrame:
    """Rows (doc_id, n, bits) of the documents that have keys, and rows of the keys as ``key_rows`` gives them.

    Documents marked in ``copies`` have their keys in their own rows instead (uses, low, gaps).
    """
    levels = Levels(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(text.as_py(), words) for text in part["text"]]
                owner, keys = index_keys(sets, classes.value, levels)
                if not len(owner):
                    continue
                keys = keys >> np.uint64(64 - KEY_BITS)
                sizes = np.array([len(x) for x in sets], np.int64)
                ids, waits = part["doc_id"].to_numpy(), marked(part["mark"].to_numpy(), copies.value)
                rows, first, uses = np.unique(owner, return_index=True, return_counts=True)
                own = [keys[k : k + n] if waits[i] else None for i, k, n in zip(rows.tolist(), first.tolist(), uses.tolist(), strict=True)]
                yield index_rows({
                    "doc_id": ids[rows], "n": sizes[rows], "bits": [bitmap(sets[k]) for k in rows], "uses": uses,
                    "low": [None if k is None else int(k[0]) for k in own], "gaps": [None if k is None else packed(np.diff(k, prepend=k[0])) for k in own],
                })
                now = ~waits[owner]
                held.append((ids[owner[now]], sizes[owner[now]], keys[now]))
                waiting += len(held[-1][0])
                if waiting > FLUSH:
                    yield key_rows(*map(np.concatenate, zip(*held, strict=True)), shards)
                    held, waiting = [], 0
        if waiting:
            yield key_rows(*map(np.concatenate, zip(*held, strict=True)), shards)

    return docs.select("doc_id", "text", mark_of().alias("mark")).mapInArrow(run, INDEX)


def late_keys(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of the keys that documents have in their own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for doc, size, n, low, gaps in zip(*(batch[x].to_pylist() for x in ("doc_id", "n", "uses", "low", "gaps")), strict=True):
                held.append((np.full(n, doc, np.int64), np.full(n, size, np.int64), np.cumsum(unpacked(gaps, n), dtype=np.uint64) + np.uint64(low)))
                waiting += n
                if waiting > FLUSH:
                    yield key_rows(*map(np.concatenate, zip(*held, strict=True)), shards)
                    held, waiting = [], 0
        if waiting:
            yield key_rows(*map(np.concatenate, zip(*held, strict=True)), shards)

    return rows.mapInArrow(run, INDEX)


def shared_lists(keys: DataFrame, threshold: Fraction) -> DataFrame:
    """(list, check, part, uses, first, docs): the documents of each key that several have, and the smallest.

    They are cut where sizes are too far apart to link; equal lists come once, long ones in parts.
    """
    top, bottom = threshold.numerator, threshold.denominator

    def run(key: tuple, group: pa.Table) -> pa.Table:
        held: list[tuple[np.ndarray, ...]] = []
        for n, low, gaps, least, owners, sizes in zip(*(group[x].to_pylist() for x in ("uses", "low", "gaps", "least", "owners", "sizes")), strict=True):
            held.append((np.cumsum(unpacked(gaps, n), dtype=np.uint64) + np.uint64(low), unpacked(owners, n).view(np.int64) + np.int64(least), unpacked(sizes, n).view(np.int64)))
        key, doc, size = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        order = order[np.append(False, same) | np.append(same, False)]
        order = order[np.lexsort((doc[order], size[order], key[order]))]
        key, doc, size = key[order], doc[order], size[order]
        other = np.append(True, np.diff(key) != 0)[: len(key)]
        new = other | np.append(True, np.diff(doc) != 0)[: len(key)]
        key, doc, size, other = key[new], doc[new], size[new], other[new]
        other[1:] |= size[:-1] * bottom < size[1:] * top
        start = np.flatnonzero(other)
        uses = np.diff(np.append(start, len(doc)))
        doc, uses = doc[np.repeat(uses > 1, uses)], uses[uses > 1]
        start = np.cumsum(uses) - uses
        if not len(uses):
            return pa.table([pa.array([], pa.int64())] * 5 + [pa.array([], pa.list_(pa.int64()))], names)
        one, two = (np.add.reduceat(mix64(doc.view(np.uint64) ^ np.uint64(x)), start) for x in (0, 0xA5A5A5A5A5A5A5A5))
        first = np.minimum.reduceat(doc, start)
        order = np.lexsort((two, one))
        once = np.zeros(len(uses), bool)
        once[order[np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))]] = True
        doc, one, two, first, uses = doc[np.repeat(once, uses)], one[once], two[once], first[once], uses[once]
        parts = -(-uses // BLOCK_SETS)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(uses) - uses, parts) + part * BLOCK_SETS
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)), pa.int32()), pa.array(doc))
        return pa.table([*(np.repeat(x, parts) for x in (one.view(np.int64), two.view(np.int64))), part, *(np.repeat(x, parts) for x in (uses, first)), lists], names)

    names = ["list", "check", "part", "uses", "first", "docs"]
    kind = "list bigint, check bigint, part bigint, uses bigint, first bigint, docs array<bigint>"
    return keys.groupBy("shard").applyInArrow(run, kind).dropDuplicates(["list", "check", "part"])


# ---------------------------------------------------------------- blocks


def paired_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of its group's blocks that has its own: adds task. ``blocks`` is the group's number of them."""
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda k: (k != F.col("_own")) | (blocks == 1))
    placed = rows.withColumn("_own", own).withColumn("_other", F.explode(others))
    return placed.withColumn("task", F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")


def forests(rows: DataFrame, columns: list[str], join: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that ``join`` finds among the rows (doc_id, columns...) of each task, one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, last = None, [], None
        found: list[tuple[int, int]] = []
        for batch in batches:
            for name, doc, *values in zip(*(batch.column(i).to_pylist() for i in range(2 + len(columns))), strict=True):
                if name != task:
                    found += join(held) if len(held) > 1 else []
                    task, held, last = name, [], None
                if doc != last:  # repeated rows once
                    held.append((doc, *values))
                    last = doc
            if len(found) > 10_000:
                yield edges(found)
                found = []
        found += join(held) if len(held) > 1 else []
        yield edges(found)

    def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    dealt = rows.select("task", "doc_id", *columns).repartition("task").sortWithinPartitions("task", "doc_id")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def spread(docs: list[int], near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which ``near`` gives those of some nodes that a node has edges to."""
    left = np.ones(len(docs), bool)
    found = []
    for seed in range(len(docs)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            rest = np.flatnonzero(left)
            if not len(rest):
                return found
            i = queue.pop()
            new = near(i, rest)
            left[new] = False
            queue += new.tolist()
            found += [(docs[i], docs[j]) for j in new.tolist()]
    return found


def may_link(threshold: Fraction) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    """For rows (doc_id, n, bits, lists): a forest of the pairs of each list whose sizes and bitmaps allow a link."""
    t, apart = float(threshold), float((1 - threshold) / (1 + threshold))

    def join(rows: list[tuple]) -> list[tuple[int, int]]:
        n = np.array([r[1] for r in rows], float)
        width = np.array([len(r[2]) for r in rows])
        bits, place = {}, {}
        for w in np.unique(width).tolist():  # bitmaps of so many bytes, wider ones folded
            wide = np.flatnonzero(width >= w)
            place[w] = np.zeros(len(rows), np.int64)
            place[w][wide] = np.arange(len(wide))
            bits[w] = np.stack([np.bitwise_xor.reduce(np.frombuffer(rows[k][2], np.uint64).reshape(-1, w // 8)) for k in wide])

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            sized = rest[(np.minimum(n[rest], n[i]) >= t * np.maximum(n[rest], n[i]) - 1e-6)]
            least, found = np.minimum(width[sized], width[i]), []
            for w in np.unique(least).tolist():
                own = sized[least == w]
                differ = np.bitwise_count(bits[w][place[w][own]] ^ bits[w][place[w][i]]).sum(axis=1, dtype=np.int64)
                found.append(own[differ <= apart * (n[own] + n[i]) + 1e-6])
            return np.concatenate([rest[:0], *found])

        members: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            for name in r[3]:
                members.setdefault(name, []).append(k)
        found: set[tuple[int, int]] = set()
        for some in members.values():
            own = np.array(some)
            found.update((rows[own[a]][0], rows[own[b]][0]) for a, b in spread(list(range(len(own))), lambda i, rest, own=own: np.flatnonzero(np.isin(own, near(own[i], own[rest])))))
        return list(found)

    return join


def links(words: int, threshold: Fraction) -> Callable[[list[tuple]], list[tuple[int, int]]]:
    """For rows (doc_id, text): a forest of their links, by exact overlaps from an inverted list."""
    top, bottom = threshold.numerator, threshold.denominator

    def join(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [shingle_set(r[1], words) for r in rows]
        sizes = np.array([len(t) for t in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        _, start, length = np.unique(tokens[order], return_index=True, return_counts=True)
        place = np.empty(len(tokens), np.int64)  # each token's posting list
        place[order] = np.repeat(np.arange(len(start)), length)
        owners = np.repeat(np.arange(len(sets)), sizes)[order]
        first = np.concatenate([[0], np.cumsum(sizes)])

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            lists = place[first[i] : first[i + 1]]
            overlap = np.bincount(np.concatenate([owners[start[k] : start[k] + length[k]] for k in lists.tolist()]), minlength=len(sets))[rest]
            return rest[bottom * overlap >= top * (sizes[rest] + sizes[i] - overlap)]

        return spread([r[0] for r in rows], near)

    return join


def canopies(lists: DataFrame, indexed: DataFrame, threshold: Fraction) -> DataFrame:
    """(doc_id, canopy) of the sets that share a key with one they may link with."""
    bins = F.ceil(F.sum("uses").over(Window.partitionBy("first")) / (4 * BLOCK_SETS))
    short = lists.filter(F.col("uses") <= BLOCK_SETS).withColumn("task", F.xxhash64("first", F.pmod("list", bins)))
    short = short.select("task", "list", F.explode("docs").alias("doc_id")).groupBy("task", "doc_id").agg(F.collect_list("list").alias("lists"))
    long = lists.filter(F.col("uses") > BLOCK_SETS).select("list", "uses", F.explode("docs").alias("doc_id"))
    long = paired_blocks(long, "list", F.ceil(F.col("uses") / BLOCK_SETS).cast("int")).select("task", "doc_id", F.array(F.lit(0).cast("bigint")).alias("lists"))
    tasks = short.unionByName(long).join(indexed.select("doc_id", "n", "bits"), "doc_id")
    return connected_components(forests(tasks, ["n", "bits", "lists"], may_link(threshold))).withColumnsRenamed({"node": "doc_id", "component": "canopy"})


def verified_links(placed: DataFrame, indexed: DataFrame, docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """(a, b): a forest of the links within canopies."""
    placed = materialize(placed.join(indexed.select("doc_id", "n"), "doc_id"), "canopies")
    blocks = placed.groupBy("canopy").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    members = join_weighted(placed, materialize(blocks, "blocks"), "canopy", "members")
    sent = docs.sparkSession.sparkContext.broadcast(marks(placed))
    tasks = paired_blocks(members, "canopy", F.col("blocks")).select("task", "doc_id").join(texts_of(docs, sent), "doc_id")
    found = materialize(forests(tasks, ["text"], links(words, threshold)), "links")
    sent.destroy()
    return found


def join_documents(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    shards = 1 << max(4, (2 * docs.rdd.getNumPartitions() - 1).bit_length())  # so that a shard has whole cells
    table = token_table(docs, words, shards)
    classes = token_classes(table, shards)
    rows = table.filter(F.col("shard").isNull()).select("doc_id", "n", "set_hash", "set_check")

    # copies: one document for each set goes on
    key = F.concat_ws(":", "set_hash", "set_check", "n")
    rows = rows.withColumn("set", F.when(F.col("n") > 0, key))
    sets = materialize(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "sets")
    several = sets.filter("copies > 1").select("set", "first", "copies")
    copies = materialize(join_weighted(rows.filter("n > 0 AND doc_id IS NOT NULL"), several, "set", "copies").filter("doc_id <> first").select("doc_id"), "copies")
    known = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id IS NOT NULL")
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in (classes, marks(copies))]
    keyed = materialize(index(known, words, sent[0], threshold, sent[1], shards), "index")
    for x in sent:
        x.destroy()
    indexed = keyed.filter(F.col("shard").isNull())
    late = late_keys(indexed.filter(F.col("gaps").isNotNull()).join(copies, "doc_id", "left_anti").select("doc_id", "n", "uses", "low", "gaps"), shards)
    lists = materialize(shared_lists(keyed.filter(F.col("shard").isNotNull()).unionByName(late), threshold), "lists")
    found = verified_links(canopies(lists, indexed, threshold), indexed, known, words, threshold)
    linked = connected_components(found).withColumnsRenamed({"node": "first", "component": "_component"})
    sets = sets.join(linked, "first", "left").select("set", "copies", F.coalesce("_component", "first").alias("component_id"))
    single = rows.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    placed = join_weighted(rows.filter("n > 0 AND doc_id IS NOT NULL"), materialize(sets, "placed-sets"), "set", "copies")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(single)


def keep_one(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the one with the smallest id, and rows without an id."""
    found = join_documents(docs.select("doc_id", "text"), words, threshold)
    lost = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, F.col("doc_id") == F.col("_lost"), "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, threshold=Fraction(85, 100))
