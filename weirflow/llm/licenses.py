"""License scans (operator 3): texts against licence templates by Dice coefficient over word bigrams.

A text is scanned in units: its lines, its paragraphs (runs of non-blank lines, where longer than a line), windows of
several paragraphs one after the other, and the whole of it (where it has more than one paragraph). A window has at
most ``WINDOW_WORDS`` words, as many as the size bound allows the longest template, its first and last paragraph share
a bigram with a template, and it is not the whole text. A notice within a longer line is in no unit of its own. A unit is normalised to the words ``[0-9a-z]+`` after A-Z are
lower-cased, and its set of word bigrams is set against each template's: 2 |A and B| / (|A| + |B|) >= ``THRESHOLD``.
With threshold t a pair can only match when t / (2 - t) <= |A| / |B| <= (2 - t) / t, which leaves few templates for a
unit, and none for a unit that shares no bigram with one; both tests are exact. Templates are a fixed list, so a unit's
work is bounded and each row is scanned where it lies, without a shuffle. Of windows only those are set against the
templates in which bigrams of templates, counted by paragraph, are enough for a match.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; a unit that matches several
templates gives a row for each; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.common import read_table

#: Numerator and denominator, so that all bounds are exact.
THRESHOLD = (4, 5)

# Licence texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
        "received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile("[0-9a-z]+")


def normalise(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def window_words(templates: dict[str, str], threshold: tuple[int, int]) -> int:
    """Words of the longest template, times the size bound."""
    top, bottom = threshold
    return max((len(normalise(t)) for t in templates.values()), default=0) * (2 * bottom - top) // top


class Scanner:
    """Templates by size, and their first words as a quick test that is exact: a shared bigram has one."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD):
        self.top, self.bottom = threshold
        self.templates = sorted(((len(b), name, b) for name, text in templates.items() if (b := bigrams(normalise(text)))), key=lambda x: x[:2])
        self.least = min((n for n, _, _ in self.templates), default=1) * self.top / (2 * self.bottom - self.top)
        self.pairs = frozenset().union(*[b for _, _, b in self.templates])
        self.window_words = window_words(templates, threshold)
        words = sorted({first for first, _ in self.pairs})
        self.any = re.compile(r"(?i)(?<![0-9A-Za-z])(?:" + "|".join(words) + r")[^0-9A-Za-z]", re.ASCII).search if words else lambda _: None

    def matches(self, unit: list[str]) -> list[tuple[str, int, int, int]]:
        """(template, shared, size of the unit's set, size of the template's set) of every match."""
        if len(unit) - 1 < self.least - 1e-9:
            return []
        found = bigrams(unit)
        n, t, rest = len(found), self.top, 2 * self.bottom - self.top
        if found.isdisjoint(self.pairs):
            return []
        out = []
        for size, name, template in self.templates:
            if size * t <= rest * n and n * t <= rest * size:
                shared = len(found & template)
                if 2 * self.bottom * shared >= t * (n + size):
                    out.append((name, shared, n, size))
        return out

    def windows(self, paragraphs: list[list[str]]) -> Iterator[tuple[int, int, list[str]]]:
        """(first, last, words) of the windows over paragraphs, given by their words, that may match."""
        found = [bigrams(words) for words in paragraphs]
        hits = [len(b & self.pairs) for b in found]
        marked = [k for k, n in enumerate(hits) if n]
        for i in marked:
            words, sum_hits, largest = len(paragraphs[i]), hits[i], len(found[i])
            for j in range(i + 1, len(paragraphs)):
                words, sum_hits, largest = words + len(paragraphs[j]), sum_hits + hits[j] + 1, max(largest, len(found[j]))
                if words > self.window_words:
                    break
                if hits[j] and j - i + 1 < len(paragraphs) and 2 * self.bottom * sum_hits >= self.top * (largest + self.templates[0][0]):
                    yield i, j, [w for p in paragraphs[i : j + 1] for w in p]

    def scan(self, text: str | None) -> list[tuple[str, int, int, str, int, int, int]]:
        """(unit, first line, lines, template, shared, unit size, template size) of every match in a text."""
        if not text or not self.any(text + " "):
            return []
        lines = text.split("\n")
        words = [normalise(line) if self.any(line + " ") else None for line in lines]
        out = [("line", k, 1, *m) for k, unit in enumerate(words) if unit for m in self.matches(unit)]
        paragraphs, start = [], None
        for k, line in enumerate([*lines, ""]):
            if line.strip(" \t\r\f\v"):
                start = k if start is None else start
            elif start is not None:
                paragraphs.append((start, k - start))
                start = None
        for start, n in paragraphs:
            if n > 1 and any(words[start : start + n]):
                out += [("paragraph", start, n, *m) for m in self.matches(normalise("\n".join(lines[start : start + n])))]
        if len(paragraphs) > 2:
            each = [normalise("\n".join(lines[start : start + n])) for start, n in paragraphs]
            for i, j, unit in self.windows(each):
                first, last = paragraphs[i][0], sum(paragraphs[j])
                out += [("window", first, last - first, *m) for m in self.matches(unit)]
        if len(paragraphs) > 1:
            out += [("text", 0, len(lines), *m) for m in self.matches(normalise(text))]
        return out


COLUMNS = ["doc_id", "unit", "first_line", "n_lines", "license", "shared", "unit_bigrams", "license_bigrams", "dice"]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every unit of every text and template that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc, *m, 2 * m[4] / (m[5] + m[6])) for m in scanner.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], COLUMNS)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, unit string, first_line bigint, n_lines bigint, license string, shared bigint, unit_bigrams bigint, license_bigrams bigint, dice double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def _values() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in TEMPLATES.items())


_FIND = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP3_SQL = f"""
WITH templates AS (
  SELECT license, {_PAIRS} AS b FROM (SELECT license, {_FIND.format('body')} AS w FROM (VALUES {_values()}) v(license, body))),
lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
numbered AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS k, unnest(ls) AS line FROM lines),
marked AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '' AS filled,
         sum(CASE WHEN trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS gap FROM numbered),
paragraphs AS (
  SELECT doc_id, min(k) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY k) AS body FROM marked WHERE filled GROUP BY doc_id, gap),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS p, count(*) OVER (PARTITION BY doc_id) AS np, {_FIND.format('body')} AS w FROM paragraphs),
placed AS (
  SELECT doc_id, first_line, n_lines, body, p, np, len(w) AS own, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY p) AS so_far,
         list_has_any({_PAIRS}, (SELECT flatten(list(b)) FROM templates)) AS hit FROM worded),
spans AS (
  SELECT a.doc_id, a.p AS p1, b.p AS p2, a.first_line, b.first_line + b.n_lines - a.first_line AS n_lines
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.p < b.p AND b.so_far - a.so_far + a.own <= {window_words(TEMPLATES, THRESHOLD)}
  WHERE a.hit AND b.hit AND b.p - a.p + 1 < a.np),
windows AS (
  SELECT s.doc_id, s.first_line, s.n_lines, string_agg(q.body, chr(10) ORDER BY q.p) AS body
  FROM spans s JOIN placed q ON q.doc_id = s.doc_id AND q.p BETWEEN s.p1 AND s.p2 GROUP BY s.doc_id, s.p1, s.p2, s.first_line, s.n_lines),
units AS (
  SELECT doc_id, 'line' AS unit, k AS first_line, 1 AS n_lines, line AS body FROM numbered
  UNION ALL SELECT doc_id, 'window', first_line, n_lines, body FROM windows
  UNION ALL SELECT doc_id, 'paragraph', first_line, n_lines, body FROM paragraphs WHERE n_lines > 1
  UNION ALL SELECT doc_id, 'text', 0, len(ls), text FROM lines WHERE doc_id IN (SELECT doc_id FROM paragraphs GROUP BY doc_id HAVING count(*) > 1)),
sets AS (
  SELECT doc_id, unit, first_line, n_lines, {_PAIRS} AS b FROM (SELECT *, {_FIND.format('body')} AS w FROM units)),
pairs AS (
  SELECT doc_id, unit, first_line, n_lines, license, len(list_intersect(s.b, t.b)) AS shared, len(s.b) AS unit_bigrams, len(t.b) AS license_bigrams
  FROM sets s JOIN templates t ON len(t.b) * {THRESHOLD[0]} <= {2 * THRESHOLD[1] - THRESHOLD[0]} * len(s.b) AND len(s.b) * {THRESHOLD[0]} <= {2 * THRESHOLD[1] - THRESHOLD[0]} * len(t.b))
SELECT doc_id, unit, CAST(first_line AS BIGINT) AS first_line, CAST(n_lines AS BIGINT) AS n_lines, license, CAST(shared AS BIGINT) AS shared,
       CAST(unit_bigrams AS BIGINT) AS unit_bigrams, CAST(license_bigrams AS BIGINT) AS license_bigrams, 2.0::DOUBLE * shared / (unit_bigrams + license_bigrams) AS dice
FROM pairs WHERE {2 * THRESHOLD[1]} * shared >= {THRESHOLD[0]} * (unit_bigrams + license_bigrams)
"""
