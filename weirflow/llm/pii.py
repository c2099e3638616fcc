"""Personal data by weak supervision (operator 1).

Four base patterns (email, ip, card, phone) always count. Beside them, wider patterns propose candidates of further
kinds. Regex, gazetteer, checksum, context and shape labelers vote on every candidate: 1 for, -1 against, 0 abstaining.
Votes are counted by kind, pattern and the cells of the span's own features (length, digits, capitals, variety,
characters before and after) over the whole corpus; there are at most 3 ** 6 patterns of a kind and 5625 cells, whatever
its size. Expectation-maximisation on these counts estimates each labeler's reliability and each pattern's posterior
(patterns of a proposed kind borrow strength from the base kinds: the reliabilities are shared). Last, a logistic span
classifier is trained on kinds, votes and cells with the posteriors as soft targets, so that spans with equal votes are
told apart by what they look like; candidates that it finds likelier than not become spans, unless they overlap a base
span or an earlier, longer one.

Every text is read once: its base spans and its candidates' votes are written to a small table, which gives both the
counts and, with the classifier, the spans.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows give repeated
results; an empty table trains nothing and gives no rows; further columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import materialize, read_table

BASE = ("email", "ip", "card", "phone")
#: Proposed kinds, in the order in which spans are listed after the base kinds.
WIDER = ("email_spelled", "iban", "local_phone", "secret", "ssn")
KINDS = BASE + WIDER
LABELERS = ("regex", "gazetteer", "checksum", "context", "against", "shape")

# Gazetteers and context words.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz io ai app dev co me tv name pro ae ar at au be bg br ca ch cl cn cz de dk ee eg es eu fi fr gr hk hr hu id ie il in ir "
    "is it jp ke kr lt lu lv ma mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us ve vn za".split()
)
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 "
    "220 221 225 233 234 237 250 251 254 255 256 260 263 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 "
    "421 423 502 503 504 505 506 507 591 593 595 598 852 853 855 880 886 961 962 963 964 965 966 967 968 971 972 973 974 994 995 996 998".split()
)
IBAN_COUNTRIES = frozenset(
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK "
    "MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
)
CONTEXT = {
    "email": "mail email e-mail contact write correo courriel",
    "email_spelled": "mail email e-mail contact write correo courriel",
    "ip": "ip address host server login client",
    "card": "card visa mastercard credit payment karte tarjeta carte",
    "phone": "phone tel telephone call mobile fax whatsapp telefon teléfono téléphone",
    "local_phone": "phone tel telephone call mobile fax whatsapp telefon teléfono téléphone",
    "iban": "iban account bank konto cuenta compte",
    "secret": "token key secret password passwd pwd apikey api_key bearer",
    "ssn": "ssn social security sin tax",
}
AGAINST = "version ver v release build isbn price usd eur order page no figure table section chapter"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}){1,3}(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.,$€-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[-. /])[0-9]{3,4}[-. ][0-9]{3,4}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?=[A-Za-z]*[0-9])[A-Za-z0-9]{32,})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_WORDS = re.compile(r"[^\W\d_]+(?:[-_][^\W\d_]+)*")
#: Characters before a span, and twice those after, in which context words count: a feature of the labelers, as the parts of an address have the lengths that the standards allow.
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: each starts in the run of local characters before its @, found from the @."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        low = max(last, text.rfind("@", last, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            found.append((start, m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdecimal() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches of the wider patterns that overlap no base span."""
    found = []
    for kind, pattern in (("email_spelled", _SPELLED), ("iban", _IBAN), ("local_phone", _LOCAL_PHONE), ("secret", _SECRET), ("ssn", _SSN)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    if not found or not base:
        return found
    starts, reach = [], []  # base spans by start, with the furthest end so far
    for _, start, end in sorted(base, key=lambda s: s[1]):
        starts.append(start)
        reach.append(max(end, reach[-1] if reach else 0))
    return [c for c in found if not (k := bisect_left(starts, c[2])) or reach[k - 1] <= c[1]]


_CONTEXT_SETS = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
_AGAINST_SET = frozenset(AGAINST.split())


def _iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One character for each labeler: + for, - against, 0 abstaining."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    near = {w.lower() for w in _WORDS.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH // 2])}
    out = []
    # regex: the strict form of the kind
    if kind in ("email", "email_spelled"):
        out.append(1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*.*[A-Za-z]{2,24}", span) else -1)
    elif kind == "secret":
        out.append(1 if re.match(r"AKIA|ASIA|gh[pousr]_", span) or re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", span) else 0)
    elif kind == "ssn":
        out.append(-1 if re.match(r"000|666|9|\d{3}-00|\d{3}-\d\d-0000", span) else 1)
    elif kind == "ip":
        out.append(-1 if re.search(r"(?:^|\.)0[0-9]", span) else 1)
    else:
        out.append(0)
    # gazetteer
    if kind == "email":
        out.append(1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else 0)
    elif kind == "email_spelled":
        out.append(1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TOP_DOMAINS else -1)
    elif kind == "phone":
        out.append(1 if any(digits[:n] in CALLING_CODES for n in (1, 2, 3)) else -1)
    elif kind == "iban":
        out.append(1 if span[:2] in IBAN_COUNTRIES else -1)
    else:
        out.append(0)
    # checksum
    if kind == "card":
        out.append(1 if luhn(digits) else -1)
    elif kind == "iban":
        out.append(1 if _iban_valid(span) else -1)
    else:
        out.append(0)
    # context for and against
    out.append(1 if near & _CONTEXT_SETS[kind] else 0)
    out.append(-1 if near & _AGAINST_SET or text[max(0, start - 1) : start] in "$€#=" and start and kind != "secret" else 0)
    # shape
    if kind in ("phone", "local_phone", "ssn", "card", "iban"):
        out.append(-1 if len(set(digits)) <= 2 else 1)
    elif kind == "secret":
        mixed = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        out.append(1 if mixed >= 2 and len(set(span)) >= 10 else -1)
    elif kind == "ip":
        out.append(-1 if span.startswith(("0.", "255.")) else 1)
    else:
        out.append(0)
    return "".join("-0+"[v + 1] for v in out)


# ---------------------------------------------------------------- reliabilities and the classifier, on counts


def reliabilities(counts: dict[tuple[str, str], int], rounds: int = 60) -> tuple[dict[tuple[str, str], float], np.ndarray, dict[str, float]]:
    """Posteriors of (kind, votes), labeler tables P(vote | truth) and each kind's prior, by expectation-maximisation.

    Labelers' tables are shared by all kinds and smoothed towards a labeler that is right three times of four.
    """
    keys = sorted(counts)
    if not keys:
        return {}, np.full((len(LABELERS), 2, 3), 1 / 3), {}
    weight = np.array([counts[k] for k in keys], float)
    vote = np.array([["-0+".index(c) for c in v] for _, v in keys])
    kind = np.array([KINDS.index(k) for k, _ in keys])
    start = np.array([[0.3, 0.6, 0.1], [0.1, 0.6, 0.3]])
    tables = np.tile(start, (len(LABELERS), 1, 1))
    prior = np.full(len(KINDS), 0.7)
    for _ in range(rounds):
        logs = np.zeros((len(keys), 2))
        for j in range(len(LABELERS)):
            logs += np.log(tables[j][:, vote[:, j]]).T
        logs += np.log(np.stack([1 - prior[kind], prior[kind]], axis=1))
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * weight[:, None]
        pseudo = 0.05 * weight.sum()
        for j in range(len(LABELERS)):
            for truth in (0, 1):
                seen = np.bincount(vote[:, j], mass[:, truth], 3) + pseudo * start[truth] + 1e-3
                tables[j, truth] = seen / seen.sum()
        total = np.bincount(kind, weight, len(KINDS))
        prior = np.clip((np.bincount(kind, mass[:, 1], len(KINDS)) + 7) / (total + 10), 0.02, 0.98)
    return {k: float(p) for k, p in zip(keys, post[:, 1], strict=True)}, tables, {k: float(prior[i]) for i, k in enumerate(KINDS)}


#: Values of each of a span's cells.
CELLS = (5, 5, 3, 3, 5, 5)


def cells(text: str, start: int, end: int) -> str:
    """A digit for each: length, share of digits, of capitals among letters, of different characters, and what stands before and after."""
    span = text[start:end]
    n, digits, upper, letters = end - start, sum(c.isdecimal() for c in span), sum(c.isupper() for c in span), sum(c.isalpha() for c in span)
    beside = lambda c: 0 if not c else 1 if c.isspace() else 4 if c.isalnum() else 2 if c in ":=.,;!?" else 3
    share = 4 if digits == n else 0 if not digits else 1 + (3 * digits > n) + (3 * digits > 2 * n)
    found = (bisect_left((12, 17, 25, 41), n + 1), share, 0 if not upper else 1 + (upper == letters), min(2, 3 * len(set(span)) // max(n, 1)), beside(text[start - 1 : start] if start else ""), beside(text[end : end + 1]))
    return "".join(map(str, found))


def features(kind: str, vote: str, cell: str) -> np.ndarray:
    """Bias, kind, votes, cells, and the first two and the fifth cell by kind."""
    k, at = KINDS.index(kind), [int(c) for c in cell]
    firsts = np.cumsum([0, *CELLS])
    blocks = [np.ones(1), np.zeros(len(KINDS)), np.zeros(2 * len(LABELERS)), np.zeros(sum(CELLS)), *(np.zeros(len(KINDS) * CELLS[j]) for j in (0, 1, 4))]
    blocks[1][k] = 1
    for j, c in enumerate(vote):
        if c != "0":
            blocks[2][2 * j + (c == "+")] = 1
    for j, value in enumerate(at):
        blocks[3][firsts[j] + value] = 1
    for block, j in zip(blocks[4:], (0, 1, 4), strict=True):
        block[k * CELLS[j] + at[j]] = 1
    return np.concatenate(blocks)


class Classifier:
    """A logistic regression on the features of spans."""

    def __init__(self, weights: np.ndarray | None):
        self.weights, self.known = weights, {}

    def probability(self, kind: str, vote: str, cell: str) -> float:
        if self.weights is None:
            return 0.0
        key = kind, vote, cell
        if key not in self.known:
            self.known[key] = float(1 / (1 + np.exp(-np.clip(features(*key) @ self.weights, -30, 30))))
        return self.known[key]


def train(counts: dict[tuple[str, str, str], int], rounds: int = 50, ridge: float = 1e-3) -> Classifier:
    """The span classifier, on the numbers of spans by kind, votes and cells: soft targets, Newton's steps."""
    patterns: Counter = Counter()
    for (kind, vote, _), c in counts.items():
        patterns[kind, vote] += c
    soft, _, _ = reliabilities(patterns)
    if not soft:
        return Classifier(None)
    keys = sorted(counts)
    x = np.array([features(*k) for k in keys])
    y = np.array([soft[k[:2]] for k in keys])
    w = np.array([counts[k] for k in keys], float)
    w /= w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta / len(keys)
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(beta)) * max(ridge / len(keys), 1e-6)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(beta)


# ---------------------------------------------------------------- Spark jobs

_FOUND = "array<struct<kind:string,start:int,stop:int,votes:string,cells:string>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.string()), ("cells", pa.string())]))


def propose_spans(text: str) -> list[dict]:
    """Base spans and candidates of a text, with votes, in the order of kinds and places."""
    base = base_spans(text)
    return [{"kind": k, "start": s, "stop": e, "votes": votes(text, k, s, e), "cells": cells(text, s, e)} for k, s, e in base + candidates(text, base)]


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every document, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [propose_spans(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND_TYPE)], ["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, found {_FOUND}"), "pii-candidates")


def train_on(found: DataFrame) -> Classifier:
    """The classifier, from all candidates of a proposed table."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.cells").count()
    return train({(r["kind"], r["votes"], r["cells"]): r["count"] for r in each.collect()})  # bounded: kinds * 3 ** labelers * cells


def accept(found: list[dict], model: Classifier, least: float = 0.5) -> list[tuple[str, int, int]]:
    """Base spans, and the candidates that the classifier takes and nothing overlaps, by kind and place."""
    base = [(f["kind"], f["start"], f["stop"]) for f in found if f["kind"] in BASE]
    more, last = [], 0
    for f in sorted((f for f in found if f["kind"] not in BASE), key=lambda f: (f["start"], -f["stop"], f["kind"])):
        if f["start"] >= last and model.probability(f["kind"], f["votes"], f["cells"]) >= least:
            more.append((f["kind"], f["start"], f["stop"]))
            last = f["stop"]
    return base + sorted(more, key=lambda x: (WIDER.index(x[0]), x[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all, n_spans."""
    found = propose(docs, id_col, text_col)
    model = train_on(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for each in batch.column(1).to_pylist():
                spans = accept(each, model)
                base = [f"{k}:{s}:{e}" for k, s, e in spans if k in BASE]
                n = Counter(k for k, _, _ in spans)
                rows.append((*[n[k] for k in BASE], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans), len(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    names = [*[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, n_spans bigint")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind; of overlapping spans the earlier, then the longer, is named and both go."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with personal data replaced by the name of its kind; null texts stay null.

    The text is scanned a second time where it lies, which is cheaper than a shuffle of texts to their spans.
    """
    model = train_on(propose(docs.withColumn("_id", F.lit(0)), "_id", text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(place)]
            new = [t and redact_text(t, accept(propose_spans(t), model)) for t in texts]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))
