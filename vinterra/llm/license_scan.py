"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Units compared are the whole text, its paragraphs (split at an empty line) and its lines, so a
notice inside a longer document is found as well as a licence file.  With ``a`` and ``b`` distinct
bigrams, ``a`` in the unit and ``b`` in the template, Dice is at most ``2 min(a, b) / (a + b)``; a
template whose size rules out the threshold is never compared.  Sizes are sorted, so the templates
left for a unit are a slice.

The template table is a parameter of a few short texts and travels with the task.  Rows are
independent: there is no shuffle.

Normalisation: A-Z become lower case; words are runs of characters outside ASCII except digits and
lower-case letters; one word alone has no bigram and matches nothing.

Defined results: null and empty texts have no unit and no licence; repeated rows get the same result
each; equal scores go to the larger template, then the smaller name, then the first unit (text,
paragraphs, lines); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinterra.llm.common import record_batches

#: Least Dice coefficient of a match.
THRESHOLD = Fraction(9, 10)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

#: Licence name and text; several texts may share a name.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{_GRANT} {_MIT_KEEP} {_AS_IS}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
]


def norm_words(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Matcher:
    """Templates ordered by size, compared only within the sizes that the threshold allows."""

    def __init__(self, templates, threshold: Fraction = THRESHOLD):
        self.threshold = threshold
        sets = sorted(((bigrams(norm_words(t)), name) for name, t in templates), key=lambda x: len(x[0]))
        self.sets = [x for x in sets if x[0]]
        self.sizes = [len(x[0]) for x in self.sets]
        p, q = threshold.numerator, threshold.denominator
        # 2 min(a, b) / (a + b) >= p / q  <=>  the larger is at most (2 q - p) / p times the smaller
        self.low = lambda a: -(-a * p // (2 * q - p))
        self.high = lambda a: a * (2 * q - p) // p
        self.least = self.low(self.sizes[0]) if self.sizes else 1
        self.most = self.high(self.sizes[-1]) if self.sizes else 0

    def compare(self, words: list[str]):
        """``(candidates compared, matches)``; a match is ``(shared, unit size, template size, name)``."""
        if len(words) <= self.least:
            return 0, []
        unit = bigrams(words)
        a = len(unit)
        if not self.least <= a <= self.most:
            return 0, []
        lo = bisect.bisect_left(self.sizes, self.low(a))
        hi = bisect.bisect_right(self.sizes, self.high(a))
        out = []
        for grams, name in self.sets[lo:hi]:
            shared = len(unit & grams)
            if 2 * shared * self.threshold.denominator >= self.threshold.numerator * (a + len(grams)):
                out.append((shared, a, len(grams), name))
        return hi - lo, out


def units(text: str):
    """Kind and text of every unit of a document."""
    yield "text", text
    paragraphs = text.split("\n\n")
    if len(paragraphs) > 1:
        for p in paragraphs:
            yield "paragraph", p
    lines = text.split("\n")
    if len(lines) > 1:
        for line in lines:
            yield "line", line


def scan_text(matcher: Matcher, text: str | None):
    """``(units, templates compared, best match or None, kind of its unit, names of all matches)``."""
    n = compared = 0
    best, kind, names = None, None, set()
    for k, unit in units(text) if text else ():
        words = norm_words(unit)
        if not words:
            continue
        n += 1
        c, found = matcher.compare(words)
        compared += c
        for m in found:
            names.add(m[3])
            rank = (Fraction(2 * m[0], m[1] + m[2]), m[2])
            old = best and (Fraction(2 * best[0], best[1] + best[2]), best[2])
            if best is None or rank > old or (rank == old and m[3] < best[3]):
                best, kind = m, k
    return n, compared, best, kind, sorted(names)


RESULT = (
    "doc_id long, n_units long, license string, unit string, shared_bigrams long, unit_bigrams long, template_bigrams long, licenses string"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per document: the best licence (null: none), its counts, and all names, comma-joined.

    Dice is ``2 * shared_bigrams / (unit_bigrams + template_bigrams)``.
    """
    table = TEMPLATES if templates is None else templates

    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, types)))

    def rows(batches):
        matcher = Matcher(table, threshold)
        for batch in batches:
            for d, text in zip(*batch.columns):
                n, _, best, kind, found = scan_text(matcher, text.as_py())
                shared, a, b, name = best or (None, None, None, None)
                yield d.as_py(), n, name, kind, shared, a, b, ",".join(found)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: record_batches(rows(batches), schema), RESULT
    )


def oracle(templates=None, threshold: Fraction = THRESHOLD) -> str:
    """DuckDB SQL of ``scan`` over ``documents``."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates or TEMPLATES))
    norm = (
        "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH t AS (SELECT k, name, {norm.format("txt")} AS w FROM (VALUES {rows}) v(k, name, txt)),
tb AS (SELECT DISTINCT k, name, w[p] AS x, w[p + 1] AS y FROM (SELECT k, name, w, unnest(range(1, len(w))) AS p FROM t)),
ts AS (SELECT k, name, count(*) AS b FROM tb GROUP BY ALL),
s AS (
  SELECT doc_id, 0 AS kind, 0 AS i, text AS u FROM documents
  UNION ALL
  SELECT doc_id, 1, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents) WHERE len(l) > 1
  UNION ALL
  SELECT doc_id, 2, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) > 1),
n AS (SELECT row_number() OVER () AS r, doc_id, kind, i, {norm.format("u")} AS w FROM s WHERE len({norm.format("coalesce(u, '')")}) > 0),
nb AS (SELECT DISTINCT r, w[p] AS x, w[p + 1] AS y FROM (SELECT r, w, unnest(range(1, len(w))) AS p FROM n)),
ns AS (SELECT r, count(*) AS a FROM nb GROUP BY r),
m AS (
  SELECT r, k, count(*) AS shared FROM nb JOIN tb USING (x, y) GROUP BY ALL),
h AS (
  SELECT n.doc_id, n.kind, n.i, ts.name, shared, a, b FROM m JOIN ns USING (r) JOIN ts USING (k) JOIN n USING (r)
  WHERE 2 * shared * {threshold.denominator} >= {threshold.numerator} * (a + b)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (2 * shared)::DOUBLE / (a + b) DESC, b DESC, name, kind, i) AS k,
         string_agg(DISTINCT name, ',' ORDER BY name) OVER (PARTITION BY doc_id) AS licenses FROM h),
c AS (SELECT doc_id, count(*) AS n_units FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, name AS license, ['text', 'paragraph', 'line'][kind + 1] AS unit,
       shared::BIGINT AS shared_bigrams, a::BIGINT AS unit_bigrams, b::BIGINT AS template_bigrams, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN o ON d.doc_id = o.doc_id AND o.k = 1
"""
