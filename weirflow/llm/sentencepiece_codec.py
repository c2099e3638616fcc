"""SentencePiece encoding and decoding (operator 7).

The pieces of a SentencePiece model, with their scores, stand in a double-array trie over UTF-8 bytes; a unigram
Viterbi search finds the segmentation with the largest sum of scores. A character that no piece covers costs the
lowest score less ten and is written as byte pieces. Blanks become markers, with one before the text; decoding joins
pieces, turns bytes and markers back and drops the leading blank.

No piece has a marker after another character, so the search runs over segments (markers and what follows them) and
each worker keeps the ids of segments it has met. Texts are never cut otherwise: the result is that of a search over
the whole text. The trie is built once on the driver; its size is the vocabulary's, and it is broadcast.

Defined cases: null and empty texts give no ids and decode to the empty text; equal sums are settled for the earlier
start of the last piece; the marker character itself in a text decodes to a blank (SentencePiece loses it too);
repeated rows give repeated results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.common import read_table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments whose ids a worker keeps, and the longest kept.
CACHE, CACHE_LENGTH = 600_000, 64
#: Characters of texts whose new segments are gathered at a time, and segments searched at once.
BLOCK_CHARS, BLOCK_SEGMENTS = 1 << 20, 4096
#: Bytes of a character by its first byte.
_WIDTH = np.repeat([1, 2, 3, 4], [0xC0, 0x20, 0x10, 0x10])


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Trie:
    """A double array over bytes: from state s by byte b to base[s] + b + 1 if check there is s; leaf[s] is an id or -1."""

    base: list[int]
    check: list[int]
    leaf: list[int]

    @classmethod
    def build(cls, pieces: dict[bytes, int]) -> Trie:
        nodes: list[dict[int, int]] = [{}]
        ids = [-1]
        for piece, number in sorted(pieces.items()):
            at = 0
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    ids.append(-1)
                at = nodes[at][byte]
            ids[at] = number
        size = 2 * len(nodes) + 600
        base, check, leaf = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        hole, probe = 300, 0  # the first free place that any byte can reach; where the search for several free places begins
        queue = [(0, 0)]
        for node, state in queue:
            leaf[state] = ids[node]
            edges = nodes[node]
            if not edges:
                continue
            if probe + 1000 > len(taken) or hole + 1000 > len(taken):
                base, check, leaf = base + [0] * size, check + [-1] * size, leaf + [-1] * size
                taken.extend(bytes(size))
            while taken[hole]:
                hole += 1
            low = min(edges)
            if len(edges) == 1:
                start = hole
                while taken[start]:
                    start += 1
                start -= low + 1
            else:
                start, tries = probe, 0
                while any(taken[start + b + 1] for b in edges):
                    start, tries = start + 1, tries + 1
                if tries > 30:
                    probe = max(probe, start - 30)
            base[state] = start
            for byte, child in edges.items():
                taken[start + byte + 1] = 1
                check[start + byte + 1] = state
                queue.append((child, start + byte + 1))
        return cls(base, check, leaf)


@dataclass
class Vocabulary:
    trie: Trie
    scores: list[float]
    spelled: list[bytes]  # what each id decodes to, markers as such
    byte_ids: list[int]
    unknown_score: float
    split: str  # characters that stand in no piece, of those texts often have

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = {i: model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        if any(MARK in piece.lstrip(MARK) for piece in plain.values()):
            raise ValueError("a piece has a marker after another character")
        scores = [model.get_score(i) for i in range(size)]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        spelled = [plain[i].encode() if i in plain else b"" for i in range(size)]
        for b, i in enumerate(byte_ids):
            spelled[i] = bytes([b])
        used = set("".join(plain.values()))
        trie = Trie.build({piece.encode(): i for i, piece in plain.items()})
        return cls(trie, scores, spelled, byte_ids, min(scores[i] for i in plain) - UNKNOWN_PENALTY, "".join(c for c in "\n\t\r" if c not in used))


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.base, self.check, self.leaf = (np.array(part, np.int64) for part in (vocabulary.trie.base, vocabulary.trie.check, vocabulary.trie.leaf))
        self.scores, self.byte_ids = np.array(vocabulary.scores), np.array(vocabulary.byte_ids, np.int64)
        alone = re.escape(vocabulary.split)
        self.segments = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")).findall

    def viterbi(self, segment: str) -> list[int]:
        v, data = self.v, segment.encode("utf-8", "surrogatepass")
        base, check, leaf, scores = v.trie.base, v.trie.check, v.trie.leaf, v.scores
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        back = [(0, -1)] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            so_far = best[start]
            width = 1 if data[start] < 0xC0 else 2 if data[start] < 0xE0 else 3 if data[start] < 0xF0 else 4
            if so_far is not None:
                state, at, single = 0, start, False
                while at < n:
                    step = base[state] + data[at] + 1
                    if check[step] != state:
                        break
                    state, at = step, at + 1
                    number = leaf[state]
                    if number >= 0:
                        single |= at == start + width
                        score = so_far + scores[number]
                        old = best[at]
                        if old is None or score > old:
                            best[at], back[at] = score, (start, number)
                if not single:
                    score, end = so_far + v.unknown_score, start + width
                    old = best[end]
                    if old is None or score > old:
                        best[end], back[end] = score, (start, -1)
            start += width
        ids: list[int] = []
        while n:
            start, number = back[n]
            ids += [number] if number >= 0 else [v.byte_ids[b] for b in reversed(data[start:n])]
            n = start
        return ids[::-1]

    def viterbi_many(self, segments: list[str]) -> list[bytes]:
        """What ``viterbi`` gives for each of many short segments, all walked through the trie and searched at once."""
        if not segments:
            return []
        encoded = [segment.encode("utf-8", "surrogatepass") for segment in segments]
        raw = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)  # a place behind each segment for its end
        ends = np.cumsum(np.array([len(data) + 1 for data in encoded])) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        owner = np.repeat(np.arange(len(segments)), ends - begins + 1)

        # pieces from every start of a character, one byte deeper each time
        inside = (raw & 0xC0) != 0x80
        inside[ends] = False
        firsts = np.flatnonzero(inside)
        widths = _WIDTH[raw]
        alone = np.zeros(len(raw), bool)
        start = at = firsts
        state = np.zeros(len(firsts), np.int64)
        found = []
        while len(start):
            step = self.base[state] + raw[at] + 1
            go = (self.check[step] == state) & (at < ends[owner[start]])
            start, at, state = start[go], at[go] + 1, step[go]
            number = self.leaf[state]
            hit = number >= 0
            found.append((start[hit], at[hit], number[hit]))
            alone[start[hit & (at == start + widths[start])]] = True
        bare = firsts[~alone[firsts]]
        found.append((bare, bare + widths[bare], np.full(len(bare), -1)))
        start, end, number = (np.concatenate(part).astype(np.int64) for part in zip(*found, strict=True))

        # by the place of their end in the segment, then by end, the earlier start first
        depth = end - begins[owner[start]]
        order = np.argsort((depth << 44) | (end << 12) | (4095 - (end - start)))
        start, end, number, depth = start[order], end[order], number[order], depth[order]
        score = np.where(number >= 0, self.scores[number], self.v.unknown_score)
        group = np.flatnonzero(np.diff(end, prepend=-1))
        sizes = np.diff(np.append(group, len(end)))
        levels = np.append(np.flatnonzero(np.diff(depth[group], prepend=-1)), len(group))
        best, last = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        for low, high in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            heads = group[low:high]
            rows = slice(heads[0], heads[-1] + sizes[high - 1])
            sums = best[start[rows]] + score[rows]
            top = np.maximum.reduceat(sums, heads - heads[0])
            which = np.repeat(np.arange(high - low), sizes[low:high])
            equal = np.flatnonzero(sums == top[which])
            equal = equal[np.diff(which[equal], prepend=-1) != 0]
            best[end[heads]], last[end[heads]] = top, equal + heads[0]

        # back from the ends
        taken = []
        at = ends[ends > begins]
        while len(at):
            piece = last[at]
            taken.append(piece)
            at = start[piece]
            at = at[at > begins[owner[at]]]
        piece = np.concatenate(taken) if taken else np.empty(0, np.int64)
        piece = piece[np.argsort(start[piece])]
        counts = np.where(number[piece] >= 0, 1, end[piece] - start[piece])
        ids = np.repeat(number[piece], counts)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        spelled = ids < 0
        ids[spelled] = self.byte_ids[raw[(np.repeat(start[piece], counts) + offset)[spelled]]]
        cuts = 4 * np.concatenate([[0], np.cumsum(np.bincount(owner[start[piece]], counts, len(segments)).astype(np.int64))])
        data, cuts = ids.astype("<u4").tobytes(), cuts.tolist()
        return [data[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; new segments of some texts are searched together."""
        found: list[np.ndarray] = []
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                found += self._encode_block(block)
                block, size = [], 0
        return found + self._encode_block(block)

    def _encode_block(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.segments((MARK + text).replace(" ", MARK)) if text else [] for text in texts]
        new = {segment for part in parts for segment in part if segment not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {segment for part in parts for segment in part}
        short = [segment for segment in new if len(segment) <= CACHE_LENGTH]
        for low in range(0, len(short), BLOCK_SEGMENTS):
            block = short[low : low + BLOCK_SEGMENTS]
            self.known.update(zip(block, self.viterbi_many(block), strict=True))
        long = {segment: np.array(self.viterbi(segment), "<u4").tobytes() for segment in new if len(segment) > CACHE_LENGTH}
        self.known.update(long)
        known = self.known.__getitem__
        found = [np.frombuffer(b"".join(map(known, part)), "<u4") for part in parts]
        for segment in long:
            del self.known[segment]
        return found

    def encode(self, text: str) -> np.ndarray:
        return self._encode_block([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        spelled = self.v.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every text; with ``decoded`` also the text that the ids decode to."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = codec.encode_all([text or "" for text in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32))
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                if decoded:
                    columns.append(pa.array([codec.decode(i) for i in ids]))
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ids of every text, as by ``encode_documents``, and checks of what they decode to.

    doc_id, n_pieces, n_byte_pieces (byte fallback), ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        is_byte = np.zeros(len(codec.v.scores), bool)
        is_byte[codec.v.byte_ids] = True
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [text or "" for text in part.column(1).to_pylist()]
                rows = []
                for text, ids in zip(texts, codec.encode_all(texts), strict=True):
                    back = codec.decode(ids)
                    rows.append((len(ids), int(is_byte[ids].sum()), ids.astype(np.int32), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    names = ["n_pieces", "n_byte_pieces", "ids", "ids_crc32", "decoded_sha256", "round_trip"]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.bool_())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces bigint, n_byte_pieces bigint, ids array<int>, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"))
