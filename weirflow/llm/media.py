"""Media columns: interleaved sequences of text and media references (operator 2).

``interleave`` parses HTML into an ordered array of structs, text or media reference, each with its position;
a figure's caption stays with its reference, or is a text where no reference takes it. ``store`` keeps payloads losslessly as 8-bit mono WAV. ``resolve``
joins references to what the stored files hold, by the payload's SHA-256 digest and length.

The payload itself never crosses a shuffle: the stored files are read back and measured where they are written,
and the digest join moves one small row per reference. A digest with a third of all references stays in place
(``join_weighted``).

Defined cases: null HTML or null text counts as empty (an empty sequence; a payload of 64 zero bytes); references
without a digest, or whose digest the store lacks, keep their place with null features; repeated rows give repeated
results; equal payloads are measured once; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import join_weighted, materialize, read_table

UNIT = 64
SAMPLE_RATE = 16000
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,n_bytes:bigint,caption:string>>"
_BREAKS = frozenset("p div br li h1 h2 h3 h4 h5 h6 article section tr td th ul ol table blockquote figure figcaption nav header footer pre title".split())
_MEDIA = frozenset("img audio video source embed".split())
_SILENT = frozenset(["script", "style"])


class _Sequence(HTMLParser):
    """Collects [kind, text, digest, n_bytes, caption] in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None
        self.waiting: list | None = None

    def flush(self) -> None:
        text = "".join(self.words)
        self.words = []
        if text.strip():
            self.items.append(["text", text, None, None, None])

    def end_caption(self) -> None:
        """Give the caption to the figure's media; without any it is a text, until one follows in the figure."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        taken = False
        for item in self.items[self.figure if self.figure is not None else len(self.items) :]:
            if item[0] == "media":
                item[4], taken = text, True
        if taken:
            self.figure = len(self.items)  # a second caption is not for the same media
        if text and not taken:
            self.items.append(["text", text, None, None, None])
            self.waiting = self.items[-1] if self.figure is not None else None

    def finish(self) -> None:
        self.end_caption()
        self.flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figure, self.waiting = len(self.items), None
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in _MEDIA:
            self.flush()
            found = dict(attrs)
            source = found.get("src") or ""
            length = found.get("data-bytes") or ""
            digest = source.rpartition(":")[2] if source.startswith("media:sha256:") else None
            self.items.append(["media", source, digest, int(length) if length.isdecimal() and len(length) < 18 else None, found.get("alt")])
            if self.waiting is not None:
                self.items = [item for item in self.items if item is not self.waiting]
                self.items[-1][4], self.waiting, self.figure = self.waiting[1], None, len(self.items)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _SILENT:
            self.silent -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag in ("figcaption", "figure"):
            self.end_caption()
        if tag in _BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = self.waiting = None

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.words.append(data)


def parse_sequence(page: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.finish()
    return [dict(zip(("kind", "text", "digest", "n_bytes", "caption"), item, strict=True)) | {"position": k} for k, item in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, sequence): each page's text and media references in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_sequence(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SEQUENCE_TYPE)], ["id", "sequence"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"id {kind}, sequence {SEQUENCE}")


_SEQUENCE_TYPE = pa.list_(
    pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("caption", pa.string())])
)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text, zero-padded to a positive multiple of 64, and their number before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM: one sample for each byte. The length is even, so no chunk needs a padding byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, bits = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data" and bits:
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def features_of(payload: bytes) -> str:
    """Sample count, sum, energy about the middle level, zero crossings and peak, as exact integers."""
    level = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(level >= 0)))
    return f"n={len(level)};sum={int(level.sum())};energy={int((level * level).sum())};crossings={crossings};peak={int(np.abs(level).max())}"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Write every text's payload to the media store; one row (digest, n_bytes, media) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = [payload_of(text) for text in batch.column(0).slice(start, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.sha256(payload).hexdigest() for payload, _ in found]),
                        pa.array([n for _, n in found], pa.int64()),
                        pa.array([to_wav(payload) for payload, _ in found], pa.binary()),
                    ],
                    ["digest", "n_bytes", "media"],
                )

    return materialize(docs.select(text_col).mapInArrow(run, "digest string, n_bytes bigint, media binary"), "media-store")


MEASURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def measure(stored: DataFrame) -> DataFrame:
    """Read the stored files back; one row for each digest and length, with ``uses``, the number of its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            payloads = [from_wav(m) for m in media]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([features_of(p) for p in payloads]),
                ],
                ["digest", "n_bytes", *MEASURES],
            )

    schema = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    rows = stored.mapInArrow(run, schema).withColumn("key", media_key())
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("uses"), *[F.max(c).alias(c) for c in MEASURES])


def media_key() -> F.Column:
    """Digest and length: texts that differ in trailing zero bytes alone have equal payloads."""
    return F.concat_ws(":", "digest", F.col("n_bytes").cast("string"))


def resolve(sequences: DataFrame, measured: DataFrame) -> DataFrame:
    """One row for each media reference: id, position, caption, n_bytes and the measures of its payload."""
    item = sequences.select("id", F.explode("sequence").alias("item")).filter("item.kind = 'media'").select("id", "item.*")
    refs = materialize(item.select("id", "position", "caption", "n_bytes", media_key().alias("key")), "media-refs")
    return join_weighted(refs, materialize(measured, "media-measures"), "key", "uses", "left")


def as_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): a page for each document, its text followed by a figure that refers to its payload by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                pages = []
                for text, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    figure = f'<figure><img src="media:sha256:{hashlib.sha256(payload).hexdigest()}" data-bytes="{n}"><figcaption>{html.escape(source or "")}</figcaption></figure>'
                    pages.append(f"<article><p>{html.escape(text or '')}</p>{figure}</article>")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages)], ["doc_id", "html"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, html string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    measured = measure(store(docs))
    found = resolve(interleave(as_pages(docs), "doc_id", "html"), measured)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", *MEASURES, "position", "caption")
