"""Fuzzy search: filter, score and rank rows against a query.

A query is a list of terms with blanks between, all of which must match; ``a | b`` takes either. ``'x`` is a literal
part, ``^x`` a prefix, ``x$`` a suffix, ``!x`` must not be there, and a bare word matches its letters in order with gaps.
A term with a capital is case-sensitive. Which rows match is decided by Spark's own predicates; only rows that do are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points of a match.
MATCH, GAP_START, GAP_MORE = 16, -3, -1
BOUNDARY, CAMEL, CONSECUTIVE, FIRST = 8, 7, 4, 2


@dataclass(frozen=True)
class Term:
    text: str
    kind: str  # fuzzy, exact, prefix, suffix or equal
    inverse: bool = False

    @property
    def cased(self) -> bool:
        return self.text != self.text.lower()


def terms(query: str) -> list[list[Term]]:
    """Sets of alternatives; every set must match."""
    found: list[list[Term]] = []
    joined = False
    for word in query.replace("\\ ", "\0").split():
        word = word.replace("\0", " ")
        if word == "|":
            joined = bool(found)
            continue
        inverse = word.startswith("!")
        word, kind = (word[1:], "exact") if inverse else (word, "fuzzy")
        if word.startswith("'"):
            word, kind = word[1:], "exact"
        elif word.startswith("^"):
            word, kind = word[1:], "prefix"
        if word.endswith("$") and word != "$":
            word, kind = word[:-1], "equal" if kind == "prefix" else "suffix"
        if word:
            if joined:
                found[-1].append(Term(word, kind, inverse))
            else:
                found.append([Term(word, kind, inverse)])
        joined = False
    return found


def matches(line: Column, term: Term) -> Column:
    text = line if term.cased else F.lower(line)
    wanted = term.text if term.cased else term.text.lower()
    if term.kind == "fuzzy":
        letters = [("\\" + c if not c.isalnum() and ord(c) < 128 else c) for c in wanted]
        hit = text.rlike("(?s)" + ".*?".join(letters))
    elif term.kind == "exact":
        hit = text.contains(wanted)
    else:
        bare = F.trim(text)
        hit = bare == wanted if term.kind == "equal" else bare.startswith(wanted) if term.kind == "prefix" else bare.endswith(wanted)
    return ~hit if term.inverse else hit


def bonus(before: str, here: str) -> int:
    """Points for a place: after a separator, at a capital after a small letter, or a digit after a letter."""
    if not before.isalnum():
        return BOUNDARY if here.isalnum() else 0
    return CAMEL if here.isupper() and before.islower() or here.isdigit() and not before.isdigit() else 0


def fuzzy_score(line: str, term: Term) -> int:
    """The best sum over all ways to place the term's letters in order: a row of best ends for each letter."""
    low = line if term.cased else line.lower()
    wanted = term.text if term.cased else term.text.lower()
    places = [bonus(line[k - 1] if k else " ", c) for k, c in enumerate(line)]
    low, n = low[: len(line)].ljust(len(line)), len(line)
    best: list[tuple[int, int] | None] = [None] * n  # score of a match that ends here, and the bonus of its run
    for i, letter in enumerate(wanted):
        row: list[tuple[int, int] | None] = [None] * n
        gap: int | None = None  # best score so far, less what the gap costs by now
        for k in range(n):
            if low[k] == letter:
                if i == 0:
                    row[k] = MATCH + places[k] * FIRST, places[k]
                else:
                    options = []
                    if k and best[k - 1]:
                        run = max(best[k - 1][1], CONSECUTIVE, places[k])
                        options.append((best[k - 1][0] + MATCH + run, run))
                    if gap is not None:
                        options.append((gap + MATCH + places[k], places[k]))
                    row[k] = max(options, default=None)
            gap = None if gap is None else gap + GAP_MORE
            if k and best[k - 1] and (gap is None or best[k - 1][0] + GAP_START > gap):
                gap = best[k - 1][0] + GAP_START
        best = row
    return max((b[0] for b in best if b), default=0)


def run_score(line: str, term: Term) -> int | None:
    """Points of the best place where a literal, prefix, suffix or whole-line term stands, its letters in a run; None where it does not."""
    low, wanted = (line, term.text) if term.cased else (line.lower(), term.text.lower())
    low = low[: len(line)].ljust(len(line))
    lead, n = len(low) - len(low.lstrip(" ")), len(wanted)
    bare = low.strip(" ")
    if term.kind == "exact":
        starts, at = [], low.find(wanted)
        while at >= 0:
            starts.append(at)
            at = low.find(wanted, at + 1)
    elif term.kind == "equal":
        starts = [lead] if bare == wanted else []
    elif term.kind == "prefix":
        starts = [lead] if bare.startswith(wanted) else []
    else:
        starts = [lead + len(bare) - n] if bare.endswith(wanted) else []
    best = None
    for start in starts:
        total = run = 0
        for k in range(start, start + n):
            here = bonus(line[k - 1] if k else " ", line[k])
            run = here if k == start else max(run, CONSECUTIVE, here)
            total += MATCH + run * (FIRST if k == start else 1)
        best = total if best is None else max(best, total)
    return best


def matched_score(line: str, term: Term) -> int | None:
    """A term's points, 0 for one that asks for absence, None where the line does not fulfil it."""
    found = (fuzzy_score(line, term) or None) if term.kind == "fuzzy" else run_score(line, term)
    return (0 if found is None else None) if term.inverse else found


def score(line: str, sets: list[list[Term]]) -> int:
    """The sum over sets of the first alternative that the line fulfils."""
    return sum(next((s for t in alternatives if (s := matched_score(line, t)) is not None), 0) for alternatives in sets)


def search(df: DataFrame, column: str, query: str, order: list[str]) -> DataFrame:
    """Rows that match, best score first, then shorter lines, then ``order``; with no positive term, in ``order``. Adds score."""
    sets = terms(query)
    hit = df.filter(F.col(column).isNotNull())
    for alternatives in sets:
        keep = matches(F.col(column), alternatives[0])
        for t in alternatives[1:]:
            keep = keep | matches(F.col(column), t)
        hit = hit.filter(keep)
    if all(t.inverse for s in sets for t in s):
        return hit.withColumn("score", F.lit(0)).orderBy(*order)

    @F.pandas_udf("int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield lines.map(lambda x: score(x, sets))

    return hit.withColumn("score", scored(column)).orderBy(F.desc("score"), F.length(column), *order)
