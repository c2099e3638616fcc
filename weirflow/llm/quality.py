"""Quality classifier (operator 6): perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted documents are all those labelled of good quality and not toxic; a fifth, by hash, is held out. From the rest:

1. the words by language with their counts, all of them, as a table; a word is a run of letters, digits (all alike),
   underscores and characters beyond ASCII, or a run of other marks;
2. frequent words, with at least one of ``RARE`` trusted words and so fewer than ``RARE`` whatever the input, have
   bigrams of their own. All others share the class ``UNKNOWN`` there, and each has within that class its discounted
   count, interpolated with the probability of its spelling (bytes of the rare words), which is all that a word never
   seen has;
3. bigram counts, summed in shards by key; shards also give the counts of counts (discounts), each frequent word's
   continuation count and each context's back-off weight.

Every document is scored. What frequent words give alone (back-off weight, continuation probability) is summed where
the text lies, and so is what the bigrams add that have at least one of ``HOT`` trusted words (fewer than ``HOT``).
All other bigrams and rare words of a block of texts go to the shards of the model, packed, without those that a Bloom
filter of fixed size knows to be unseen; there a join by key gives what each adds, in whole ``UNIT`` parts, and a
text's parts are summed in its block (exact in any order). The number of shards follows the model's size. A shard's
model rows come first, then its blocks one by one, so a task holds one shard of the model and one block.

A document's perplexity is smoothed by ``PRIOR_TOKENS`` tokens of its language's mean, and it is kept when that is at
most the quantile ``KEEP`` of the held-out trusted documents of its language.

Defined cases: null and empty texts are not kept; a null language is a language of its own; languages with fewer than
``LEAST`` held-out documents take the quantile of all; without any labels every document with a word is kept; documents
with contradictory labels are not trusted; repeated rows get equal verdicts; further columns stay in ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.llm.common import materialize, mix64, read_table
from weirflow.llm.spans import SPACES, Lookup, gathered, slices, span_hashes, spans

RARE = 1_000_000
HOT = 1 << 20
KEEP = 0.995
PRIOR_TOKENS = 40
LEAST = 20
HELD_OUT = 5
START, UNKNOWN, FIRST = 0, 1, 2
#: Bits of a word's number in a bigram's key.
SHIFT = np.uint64(20)
UNIT = 10_000
BLOOM_BITS = 1 << 27
#: Trusted words for each shard of the model; the fewest shards; bytes of text in a block.
SHARD_TOKENS, FEWEST, BLOCK_BYTES = 1 << 22, 16, 16 << 20
#: Distinct words after which a task's counts are merged.
MERGE = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[48:58] = 48
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[b for b in range(256) if b >= 128 or b == 95 or chr(b).isalnum()]] = 1
_CLASS[SPACES] = 0


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, held) of the trusted documents."""
    each = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 AND t = 0")
    return materialize(each.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held")), "trusted")


def language_keys(langs: pa.Array) -> np.ndarray:
    """A hash of each language; null is one of its own."""
    coded = langs.dictionary_encode() if not pa.types.is_dictionary(langs.type) else langs
    names = coded.dictionary.to_pylist()
    keys = np.array([0, *(int(word_keys(pa.array([n]), None)[0]) | 1 for n in names)], np.uint64)
    return keys[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1]


def word_keys(words: pa.Array, languages: np.ndarray | None) -> np.ndarray:
    """Hashes of whole words, of a language each."""
    if not len(words):
        return np.empty(0, np.uint64)
    found = []
    for _, _, raw, offsets in slices(words):
        found.append(span_hashes(raw, offsets[:-1], offsets[1:]))
    keys = np.concatenate(found)
    return keys if languages is None else mix64(keys ^ languages)


@dataclass
class Words:
    """The words of a slice of texts: text, hash with its language, begin and end in the bytes."""

    text: np.ndarray
    key: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    raw: np.ndarray
    first: np.ndarray  # whether a word is its text's first


def words_of(raw: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> Words:
    raw = _FOLD[raw]
    begin, end, text = spans(_CLASS[raw], offsets)
    first = np.ones(len(text), bool)
    np.not_equal(text[1:], text[:-1], out=first[1:])
    return Words(text, mix64(span_hashes(raw, begin, end) ^ languages[text]), begin, end, raw, first)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, c) of all words of (lang, text)."""

    def merged(parts: list[tuple]) -> tuple:
        keys = np.concatenate([p[0] for p in parts])
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(first)).astype(np.int64)
        langs, words = (pa.chunked_array([p[i] for p in parts]).combine_chunks().take(pa.array(first)) for i in (2, 3))
        return keys[first], counts, langs, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            langs = language_keys(batch.column(0))
            for low, high, raw, offsets in slices(batch.column(1)):
                found = words_of(raw, offsets, langs[low:high])
                keys, first, counts = np.unique(found.key, return_index=True, return_counts=True)
                parts.append((keys, counts, batch.column(0).take(pa.array(low + found.text[first])), gathered(found.raw, found.begin[first], found.end[first])))
                if sum(len(p[0]) for p in parts) > MERGE:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > MERGE // 2:
                        yield pa.RecordBatch.from_arrays([parts[0][2], parts[0][3].cast(pa.string()), pa.array(parts[0][1])], ["lang", "word", "c"])
                        parts = []
        if parts:
            _, counts, langs, words = merged(parts)
            yield pa.RecordBatch.from_arrays([langs, words.cast(pa.string()), pa.array(counts)], ["lang", "word", "c"])

    rows = texts.select("lang", "text").mapInArrow(run, "lang string, word string, c bigint")
    return materialize(rows.groupBy("lang", "word").agg(F.sum("c").alias("c")), "word-counts")


def modified_discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0 to 3 and more, from the numbers of things seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = np.maximum(np.asarray(n).astype(float), 1)
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.1, 0.2, 0.3], [0, 0.95, 1.9, 2.9])


def counts_of_counts(column: str = "c") -> list:
    return [F.count_if(F.col(column) == k).alias(f"n{k}") for k in (1, 2, 3, 4)] + [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(column), F.lit(0)).alias("total")]


@dataclass
class Vocabulary:
    """The frequent words, fewer than ``RARE``, and what tells of the others."""

    look: Lookup
    least: int  # count of a frequent word
    total: int  # trusted words
    byte_logs: np.ndarray  # log probability of each byte of a rare word, its end last
    rare_total: int
    rare_discounts: np.ndarray
    rare_left: float  # share of the class that its words' spelling takes

    @property
    def size(self) -> int:
        return FIRST + len(self.look.keys) - 1

    @classmethod
    def choose(cls, counts: DataFrame) -> Vocabulary:
        total = counts.agg(F.sum("c")).first()[0] or 0
        least = max(2, -(-total // RARE))
        words = counts.filter(F.col("c") >= least).select("lang", "word").toArrow().combine_chunks()  # fewer than RARE rows
        langs, names = (words[c].combine_chunks() if words.num_rows else pa.array([], pa.string()) for c in ("lang", "word"))
        keys = np.unique(word_keys(names, language_keys(langs)))

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(257, np.int64)
            for batch in batches:
                for low, high, raw, _ in slices(batch.column(0)):
                    seen[:256] += np.bincount(raw, minlength=256)
                    seen[256] += high - low
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(seen[seen > 0])], ["byte", "c"])

        rare = counts.filter(F.col("c") < least)
        seen = np.full(257, 0.1)
        for r in rare.select("word").mapInArrow(spell, "byte bigint, c bigint").groupBy("byte").agg(F.sum("c").alias("c")).collect():  # 257 rows at most
            seen[r["byte"]] += r["c"]
        n = rare.agg(*counts_of_counts()).first()
        discounts = modified_discounts(np.array([n["n1"], n["n2"], n["n3"], n["n4"]]))
        by = np.array([n["n1"], n["n2"], n["n"] - n["n1"] - n["n2"]])
        left = float(discounts[1:] @ by) / n["total"] if n["total"] else 1.0
        return cls(Lookup(keys), least, total, np.log(seen / seen.sum()), max(1, n["total"]), discounts, left)

    def spelling(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability, within the class of rare words, of a word never seen."""
        sums = np.concatenate([[0.0], np.cumsum(self.byte_logs[raw])])
        return sums[end] - sums[begin] + self.byte_logs[256] + np.log(self.rare_left)

    def ids(self, found: Words) -> np.ndarray:
        at = self.look(found.key)
        return np.where(at < 0, UNKNOWN, at + FIRST).astype(np.uint64)

    def bigrams(self, found: Words, ids: np.ndarray) -> np.ndarray:
        """context << SHIFT | word of every word, the first of a text after START."""
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[found.first] = START
        return (context << SHIFT) | ids


# ---------------------------------------------------------------- packed keys and counts


def planes(values: np.ndarray) -> bytes:
    """Bytes of whole numbers by significance, so that the empty ones compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys by their differences, and further columns of 32-bit numbers, compressed."""
    data = planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(planes(m.astype(np.uint32)) for m in more)
    return len(keys).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    plain = pa.decompress(data[8:], n * (8 + 4 * columns), codec="zstd", asbytes=True)
    parts = [plain[8 * n + 4 * n * k : 8 * n + 4 * n * (k + 1)] for k in range(columns)]
    return [np.cumsum(unplanes(plain[: 8 * n], np.uint64), dtype=np.uint64), *(unplanes(p, np.uint32) for p in parts)]


def entry_hashes(bigrams: np.ndarray) -> np.ndarray:
    return mix64(bigrams + np.uint64(1))


def rare_hashes(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the lowest 16 bits; the others tell the entries of a shard apart."""
    return ((hashes & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and where its rows are, in order."""
    order = np.argsort(shard.astype(np.uint16), kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)):
        yield int(s), order[ends[s] : ends[s + 1]]


def bigram_counts(texts: DataFrame, vocabulary: Broadcast, shards: int) -> DataFrame:
    """(shard, data), one row for each shard: its bigrams' keys, sorted, and counts."""

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        found = [(s, packed(keys[at], counts[at])) for s, at in by_shard(shard_of(entry_hashes(keys), shards), shards)]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["shard", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            langs = language_keys(batch.column(0))
            for low, high, raw, offsets in slices(batch.column(1)):
                found = words_of(raw, offsets, langs[low:high])
                parts.append(np.unique(vocabulary.value.bigrams(found, vocabulary.value.ids(found)), return_counts=True))
                if sum(len(p[0]) for p in parts) > MERGE:
                    parts = [added(parts)]
                    if len(parts[0][0]) > MERGE // 2:
                        yield rows(*parts.pop())
        if parts:
            yield rows(*added(parts))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = added([tuple(unpacked(d, 1)) for d in table["data"].to_pylist()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": [packed(keys, np.minimum(counts, 0xFFFFFFFF))]})

    schema = "shard int, data binary"
    return materialize(texts.select("lang", "text").mapInArrow(count, schema).groupBy("shard").applyInArrow(add, schema), "bigram-counts")


@dataclass
class Model:
    """What the frequent words alone give: arrays by word, and the discounts."""

    discounts: np.ndarray  # of counts 0, 1, 2, 3 or more
    context: np.ndarray  # c(v .)
    backoff: np.ndarray  # log of the weight left for the continuation probability
    word: np.ndarray  # log continuation probability
    shards: int
    bloom: np.ndarray | None = None
    hot: Lookup | None = None  # hashes of hot bigrams, and what they add
    hot_adds: np.ndarray | None = None

    def adds(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the log probability of a bigram with such counts has over that of an unseen one, in UNIT parts."""
        v, w = (keys >> SHIFT).astype(np.int64), (keys & ((np.uint64(1) << SHIFT) - np.uint64(1))).astype(np.int64)
        direct = (counts - self.discounts[np.minimum(counts, 3)]) / self.context[v]
        return np.rint(np.log1p(direct / np.exp(self.backoff[v] + self.word[w])) * UNIT).astype(np.int64)


def estimate(counts: DataFrame, size: int, shards: int) -> Model:
    """The model from sharded counts: sums of arrays as long as the list of frequent words."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = np.zeros((5, size), np.int64)  # by context: tokens, bigrams seen once, twice, more often; by word: contexts
        n = np.zeros(4, np.int64)
        for batch in batches:
            for data in batch.column(1).to_pylist():
                keys, c = unpacked(data, 1)
                c = c.astype(np.int64)
                v, w = (keys >> SHIFT).astype(np.int64), (keys & ((np.uint64(1) << SHIFT) - np.uint64(1))).astype(np.int64)
                stats[0] += np.bincount(v, c, size).astype(np.int64)
                for j in (1, 2, 3):
                    stats[j] += np.bincount(v[np.minimum(c, 3) == j], minlength=size)
                stats[4] += np.bincount(w, minlength=size)
                n += np.bincount(c[c <= 4], minlength=5)[1:5]
        row, at = np.nonzero(stats)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(row, [5] * 4), pa.int32()), pa.array(np.append(at, range(4)), pa.int64()), pa.array(np.append(stats[row, at], n), pa.int64())], ["kind", "at", "n"])

    found = counts.mapInArrow(measure, "kind int, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()  # 5 * RARE + 4 rows at most
    stats = np.zeros((6, max(size, 4)), np.int64)
    stats[found["kind"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    n, stats = stats[5, :4], stats[:5, :size]
    d = modified_discounts(n)
    context = np.maximum(stats[0], 1)
    left = np.where(stats[0] > 0, (d[1:] @ stats[1:4]) / context, 1.0)
    contexts, total = stats[4], max(1, stats[4].sum())
    own = modified_discounts(np.array([(contexts == k).sum() for k in (1, 2, 3, 4)]))[np.minimum(contexts, 3)]
    word = np.maximum(contexts - own, 0) / total
    word += (1 - word.sum()) / size
    return Model(d, context.astype(float), np.log(np.maximum(left, 1e-9)), np.log(word), shards)


def bloom_places(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for an entry, both in the slice of its shard."""
    width = BLOOM_BITS // shards // 8 * 8
    base = shard_of(hashes, shards) * width
    high = hashes >> np.uint64(16)
    return base + (high % np.uint64(width)).astype(np.int64), base + (((high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(width)).astype(np.int64)


def entries(bigrams: DataFrame, words: DataFrame, vocabulary: Broadcast, model: Broadcast, hot: int) -> DataFrame:
    """(shard, data, bits): what each bigram that is not hot and each rare word adds, and the shard's Bloom filter, packed."""
    shards = model.value.shards

    def rows(hashes: np.ndarray, adds: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(hashes)
        hashes, adds = hashes[order], adds[order]
        found = [(s, packed(hashes[at], adds[at])) for s, at in by_shard(shard_of(hashes, shards), shards)]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["shard", "data"])

    def of_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                keys, counts = unpacked(data, 1)
                cold = counts < hot
                yield rows(entry_hashes(keys[cold]), model.value.adds(keys[cold], counts[cold].astype(np.int64)))

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            langs, c = language_keys(batch.column(0)), batch.column(2).to_numpy()
            direct = (c - v.rare_discounts[np.minimum(c, 3)]) / v.rare_total
            unseen = np.concatenate([np.empty(0), *(v.spelling(raw, o[:-1], o[1:]) for _, _, raw, o in slices(batch.column(1)))])
            yield rows(rare_hashes(word_keys(batch.column(1), langs)), np.rint(np.logaddexp(np.log(np.maximum(direct, 1e-300)) - unseen, 0.0) * UNIT).astype(np.int64))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpacked(d, 1) for d in table["data"].to_pylist()]
        hashes, adds = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(hashes, kind="stable")
        hashes, adds = hashes[order], adds[order]
        width = BLOOM_BITS // shards // 8 * 8
        bits = np.zeros(width, bool)
        for place in bloom_places(hashes, shards):
            bits[place - key[0].as_py() * width] = True
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": [packed(hashes, adds)], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    rare = words.filter(F.col("c") < vocabulary.value.least).select("lang", "word", "c")
    both = bigrams.mapInArrow(of_bigrams, "shard int, data binary").unionByName(rare.mapInArrow(of_words, "shard int, data binary"))
    return materialize(both.groupBy("shard").applyInArrow(merge, "shard int, data binary, bits binary"), "entries")


def complete(model: Model, bigrams: DataFrame, found: DataFrame, hot: int) -> Model:
    """The model with its hot bigrams, fewer than ``HOT``, and its Bloom filter of ``BLOOM_BITS``."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                keys, counts = unpacked(data, 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= hot].astype(np.int64)), pa.array(counts[counts >= hot].astype(np.int64))], ["key", "c"])

    rows = bigrams.mapInArrow(most, "key bigint, c bigint").toArrow()
    keys = rows["key"].to_numpy().astype(np.uint64)
    hashes = entry_hashes(keys)
    order = np.argsort(hashes)
    model.hot, model.hot_adds = Lookup(hashes[order]), np.append(model.adds(keys, rows["c"].to_numpy())[order], 0)
    width = BLOOM_BITS // model.shards // 8
    model.bloom = np.zeros(width * model.shards, np.uint8)
    for r in found.select("shard", "bits").toLocalIterator():
        model.bloom[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return model


def score(docs: DataFrame, sent: Broadcast, sent_model: Broadcast, found: DataFrame) -> DataFrame:
    """(doc_id, lang, n_tokens, log_probability) of every document."""
    shards = sent_model.value.shards
    names = ["shard", "kind", "block", "data", "own"]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def flush(block: int, own: list[pa.RecordBatch], hashes: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A block's own sums to one shard, and its entries to theirs."""
        entry, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(entry, kind="stable")
        entry, owner = entry[order], owner[order]
        first = np.ones(len(entry), bool)
        first[1:] = (entry[1:] != entry[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(entry)))
        entry, owner = entry[at], owner[at]
        for s, rows in by_shard(shard_of(entry, shards), shards):
            yield batch_of([(s, 1, block, packed(entry[rows] >> np.uint64(16), owner[rows], times[rows]), None)])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own[0].schema) as writer:
            for batch in own:
                writer.write_batch(batch)
        yield batch_of([(block % shards, 1, block, None, sink.getvalue().to_pybytes())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = sent.value, sent_model.value
        number = TaskContext.get().partitionId() << 32
        word, backoff = (np.rint(x * UNIT) for x in (model.word, model.backoff))
        own, hashes, owners, size, rows = [], [], [], 0, 0
        for batch in batches:
            langs = language_keys(batch.column(1))
            for low, high, raw, offsets in slices(batch.column(2)):
                if own and size + len(raw) > BLOCK_BYTES:
                    yield from flush(number, own, hashes, owners)
                    number, own, hashes, owners, size, rows = number + 1, [], [], [], 0, 0
                found = words_of(raw, offsets, langs[low:high])
                ids = v.ids(found)
                keys = v.bigrams(found, ids)
                entry = entry_hashes(keys)
                parts = word[ids] + backoff[keys >> SHIFT]
                hot = model.hot(entry)
                parts[hot >= 0] += model.hot_adds[hot[hot >= 0]]
                rare = np.flatnonzero(ids == UNKNOWN)
                parts[rare] += np.rint(v.spelling(found.raw, found.begin[rare], found.end[rare]) * UNIT)
                cold = np.flatnonzero(hot < 0)
                entry = np.concatenate([entry[cold], rare_hashes(found.key[rare])])
                maybe = np.ones(len(entry), bool)
                for place in bloom_places(entry, shards):
                    maybe &= (model.bloom[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                hashes.append(entry[maybe])
                owners.append(np.concatenate([found.text[cold], found.text[rare]])[maybe] + rows)
                count = high - low
                base = np.bincount(found.text, parts, count).astype(np.int64)
                tokens = np.bincount(found.text, minlength=count)
                own.append(pa.record_batch([batch.column(0).slice(low, count), batch.column(1).slice(low, count), pa.array(tokens), pa.array(base)], ["doc_id", "lang", "n_tokens", "base"]))
                rows, size = rows + count, size + len(raw)
        if own:
            yield from flush(number, own, hashes, owners)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The count join: of each shard the entries come first, then the blocks one by one."""
        at, look, adds = -1, Lookup(np.empty(0, np.uint64)), np.zeros(1, np.int64)
        for batch in batches:
            out = []
            for shard, kind, block, data, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, look, adds = shard, Lookup(np.empty(0, np.uint64)), np.zeros(1, np.int64)
                if kind == 0:
                    known, adds = unpacked(data, 1)
                    look, adds = Lookup(known >> np.uint64(16) << np.uint64(16)), np.append(adds.astype(np.int64), 0)
                elif own is not None:
                    out.append((block, None, own))
                else:
                    entry, owner, times = unpacked(data, 2)
                    place = look(entry << np.uint64(16))
                    parts = np.bincount(owner, np.where(place >= 0, adds[place] * times, 0)).astype(np.int64)
                    some = np.flatnonzero(parts)
                    out.append((block, packed(some.astype(np.uint64), parts[some] & 0xFFFFFFFF, parts[some] >> 32), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["block", "parts", "own"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """The sums of one block."""
        own = next(o for o in table["own"].to_pylist() if o is not None)
        rows = pa.ipc.open_stream(own).read_all()
        total = rows["base"].to_numpy().copy()
        for parts in table["parts"].to_pylist():
            if parts is not None:
                some, low, high = unpacked(parts, 2)
                total[some.astype(np.int64)] += low.astype(np.int64) | high.astype(np.int64) << 32
        return pa.table({"doc_id": rows["doc_id"], "lang": rows["lang"], "n_tokens": rows["n_tokens"], "log_probability": total / UNIT})

    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = docs.select("doc_id", "lang", "text").mapInArrow(send, "shard int, kind int, block bigint, data binary, own binary")
    model_rows = found.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("block"), "data", F.lit(None).cast("binary").alias("own"))
    joined = model_rows.unionByName(blocks).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(join, "block bigint, parts binary, own binary")
    return joined.groupBy("block").applyInArrow(gather, f"doc_id {kind}, lang string, n_tokens bigint, log_probability double")


LEVEL = 1000  # levels of log perplexity in a unit


def scored(docs: DataFrame, trust: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the trusted ones that are not held out."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    train = texts.join(trust.filter("NOT held").select("doc_id"), "doc_id", "left_semi")
    words = word_counts(train)
    sent_words = spark.sparkContext.broadcast(Vocabulary.choose(words))
    shards = min(1 << 16, max(FEWEST, sent_words.value.total // SHARD_TOKENS))
    hot = max(2, sent_words.value.total // HOT)
    bigrams = bigram_counts(train, sent_words, shards)
    model = estimate(bigrams, sent_words.value.size, shards)
    sent_model = spark.sparkContext.broadcast(model)
    found = entries(bigrams, words, sent_words, sent_model, hot)
    sent_model.destroy()
    sent_model = spark.sparkContext.broadcast(complete(model, bigrams, found, hot))
    scores = materialize(score(texts, sent_words, sent_model, found), "scores")
    for sent in (sent_words, sent_model):
        sent.destroy()
    return scores


def limits(scores: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, mean, threshold) by language: the quantile ``KEEP`` of its held-out documents, or of all where it has few; null without any."""
    means = scores.filter("n_tokens > 0").groupBy("lang").agg((-F.sum("log_probability") / F.sum("n_tokens")).alias("mean"))
    levels = smoothed(scores.join(held, "doc_id", "left_semi").filter("n_tokens > 0"), materialize(means, "means"))
    levels = materialize(levels.groupBy("lang", F.ceil(F.col("log_perplexity") * LEVEL).alias("level")).agg(F.count(F.lit(1)).alias("n")), "levels")

    def quantile(rows: DataFrame, *by: str) -> DataFrame:
        so_far = F.sum("n").over(W.partitionBy(*by).orderBy("level")) if by else F.sum("n").over(W.orderBy("level"))
        total = F.sum("n").over(W.partitionBy(*by)) if by else F.sum("n").over(W.partitionBy())
        return rows.withColumn("so_far", so_far).withColumn("total", total).filter(F.col("so_far") >= KEEP * F.col("total")).groupBy(*by).agg((F.min("level") / LEVEL).alias("threshold"), F.max("total").alias("of"))

    pooled = quantile(levels.groupBy("level").agg(F.sum("n").alias("n"))).first()
    own = quantile(levels, "lang").filter(F.col("of") >= LEAST).select(F.col("lang").alias("_l"), F.col("threshold").alias("_t"))
    of_all = F.lit(pooled["threshold"] if pooled else None).cast("double")
    return means.join(own, F.col("lang").eqNullSafe(F.col("_l")), "left").select("lang", "mean", F.coalesce("_t", of_all).alias("threshold"))


def smoothed(scores: DataFrame, means: DataFrame) -> DataFrame:
    """``scores`` with what ``means`` says of the language and ``log_perplexity``."""
    found = means.withColumnRenamed("lang", "_l")
    prior = PRIOR_TOKENS * F.coalesce("mean", F.lit(0.0))
    return scores.join(found, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l").withColumn("log_perplexity", (prior - F.col("log_probability")) / (F.col("n_tokens") + PRIOR_TOKENS))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, log_perplexity, threshold, kept of every document."""
    trust = trusted(labels)
    scores = scored(docs, trust)
    by_language = materialize(limits(scores, trust.filter("held").select("doc_id")), "limits")
    limit = F.coalesce("threshold", F.lit(float("inf")))
    return smoothed(scores, by_language).select("doc_id", "lang", "n_tokens", "log_perplexity", limit.alias("threshold"), ((F.col("n_tokens") > 0) & (F.col("log_perplexity") <= limit)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``judge`` keeps. Rows without an id are judged by nothing and go."""
    kept = judge(docs, labels).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_kept_id"), "left_semi")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
