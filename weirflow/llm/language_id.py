"""Language identification of pages by Bayesian evidence fusion (operator 8).

Evidence, as log likelihoods for each language:
- the text: byte trigrams of the page's lower-cased text under counts of labelled documents, hashed to ``BUCKETS``;
  the sum weighs as at most ``EFFECTIVE`` trigrams, for they aren't independent;
- the language that the markup declares (``<html lang=...>``), right with probability ``DECLARED``;
- the address suffix, where it belongs to a country, with ``SUFFIX``.

Priors come from the hosts: the posteriors without a prior are summed by host, by domain and over all (grouped
aggregation, as whole millionths, so sums don't depend on order); a host's prior is smoothed by ``STRENGTH`` pages of
its domain's, the domain's by the whole corpus's, and that by a uniform one. A page's own share is taken out of its
host's sums. A host with a third of all pages stays in place (``join_weighted``).

The trained table has BUCKETS numbers for each language, whatever the corpus, and is broadcast.

Defined cases: null HTML or address count as empty: such a page has the prior alone; ties go to the language first in
the alphabet; documents without a language train nothing; without any labelled document there are no languages and
``lang`` is null; repeated rows count as pages of their own; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import join_weighted, materialize, read_table

BUCKETS = 1 << 14
EFFECTIVE = 60
DECLARED, SUFFIX = 0.9, 0.8
STRENGTH = 10.0
UNIT = 1_000_000

# Country suffixes and their main languages.
SUFFIX_LANGUAGE = {
    "at": "de", "de": "de", "li": "de",
    "fr": "fr", "mc": "fr", "sn": "fr",
    "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es", "pe": "es",
    "au": "en", "gb": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en",
}
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""")


def trigram_buckets(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bucket under each, from all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigram_buckets(text.as_py()), minlength=BUCKETS)
        for lang, row in counts.items():
            full = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full), pa.array(row[full])], ["lang", "bucket", "c"])

    rows = labelled.select(lang_col, text_col).dropna().filter(F.col(lang_col) != "").mapInArrow(run, "lang string, bucket bigint, c bigint")
    table = rows.groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()  # languages * BUCKETS rows at most
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in table["lang"]], table["bucket"]] = table["c"]
    return languages, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def page_evidence(page: str, url_suffix: str, languages: list[str], table: np.ndarray, use_declared: bool = True) -> tuple[np.ndarray, str | None, str | None]:
    """Log likelihoods by language, the declared language, and the one that the text alone favours."""
    k = len(languages)
    total = np.zeros(k)
    found = trigram_buckets(html.unescape(_HIDDEN.sub(" ", page)))
    by_text = None
    if len(found) and k:
        score = table[:, found].sum(axis=1) * min(1.0, EFFECTIVE / len(found))
        by_text = languages[int(score.argmax())]
        total += score
    said = _LANG.search(page)
    declared = said[1].lower() if said else None
    for hint, right in ((declared if use_declared else None, DECLARED), (SUFFIX_LANGUAGE.get(url_suffix), SUFFIX)):
        if hint in languages and k > 1:
            total += np.log(np.where(np.array(languages) == hint, right, (1 - right) / (k - 1)))
    return total, declared, by_text


def identify(pages: DataFrame, labelled: DataFrame, use_declared: bool = True) -> DataFrame:
    """page_id, lang, probability, text_lang, declared_lang, host, host_pages of pages (page_id, url, html)."""
    spark = pages.sparkSession
    languages, table = train(labelled)
    k = len(languages)
    sent = spark.sparkContext.broadcast(table.astype(np.float32))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_evidence(page or "", suffix, languages, sent.value, use_declared) for page, suffix in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            logs = np.array([x for x, _, _ in found]).reshape(len(found), k)
            soft = np.rint(softmax(logs) * UNIT).astype(np.int64) if k else np.zeros((len(found), 0), np.int64)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(ends, pa.array(logs.ravel(), pa.float64())),
                    pa.ListArray.from_arrays(ends, pa.array(soft.ravel(), pa.int64())),
                    pa.array([d for _, d, _ in found], pa.string()),
                    pa.array([t for _, _, t in found], pa.string()),
                ],
                ["page_id", "host", "logs", "soft", "declared_lang", "text_lang"],
            )

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    addressed = pages.select("page_id", host.alias("host"), "html", F.substring_index(host, ".", -1).alias("suffix"))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, logs array<double>, soft array<bigint>, declared_lang string, text_lang string"
    seen = materialize(addressed.mapInArrow(evidence, schema), "page-evidence")

    # sums by host, domain and over all; each level's prior smoothed by the next one's
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(k)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    hosts = materialize(seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("domain", F.substring_index("host", ".", -2)), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_hosts"), *again)
    whole = domains.agg(F.sum("n").alias("n"), *again).first()
    n = whole["n"] or 0
    smoothed = lambda s, n, prior: (s + STRENGTH * UNIT * prior) / ((n + STRENGTH) * UNIT)
    top = [smoothed(whole[f"s{i}"] or 0, n, 1 / k) for i in range(k)]
    domains = domains.select("domain", "n_hosts", *[smoothed(F.col(f"s{i}"), F.col("n"), top[i]).alias(f"p{i}") for i in range(k)])
    hosts = join_weighted(hosts, materialize(domains, "domains"), "domain", "n_hosts")
    hosts = materialize(hosts.select("host", "n", F.array(*[f"s{i}" for i in range(k)]).cast("array<bigint>").alias("s"), F.array(*[f"p{i}" for i in range(k)]).cast("array<double>").alias("p")), "host-priors")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            logs, soft, s, p = (np.array(batch.column(c).to_pylist(), float).reshape(size, k) for c in ("logs", "soft", "s", "p"))
            pages_of = batch.column("n").to_numpy()
            best, sure = [None] * size, np.full(size, np.nan)
            if k and size:
                prior = smoothed(s - soft, (pages_of - 1)[:, None], p)
                post = softmax(logs + np.log(np.maximum(prior, 1e-12)))
                row = post.argmax(axis=1)
                best, sure = [languages[i] for i in row], post[np.arange(size), row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(best, pa.string()), pa.array(sure), batch.column("text_lang"), batch.column("declared_lang"), batch.column("host"), batch.column("n")],
                ["page_id", "lang", "probability", "text_lang", "declared_lang", "host", "host_pages"],
            )

    out = f"page_id {kind}, lang string, probability double, text_lang string, declared_lang string, host string, host_pages bigint"
    return join_weighted(seen, hosts, "host", "n").mapInArrow(fuse, out)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
