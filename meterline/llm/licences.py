"""Licence scan: TF-IDF cosine of headers and licence files to templates, and inheritance from the nearest directory.

What is compared with the templates, as sparse vectors of term counts times inverse document frequency:
every single line; every block, that is a longest run of lines of one kind (comment lines, or other lines)
without a line between them that holds no term, so wrapped headers and paragraphs of longer texts are whole; and the whole text of a file
named as a licence file.  Frequencies are those of all terms over all documents.  A declared
``SPDX-License-Identifier`` counts as a score of 1 for the licence it names.
Units without a marking term, or whose cosine cannot reach the threshold even if all their other terms were in every
document, are left out before anything is shuffled: neither can change a result.
A file's own licence is that of its best unit; a file without one takes that of the licence file in the
nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import salted_join
from meterline.llm.tables import pieces, record
from meterline.session import settle

# Public licence texts, notices and customary header lines.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    'publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, '
    'subject to the following conditions:')
_MIT_REST = (
    'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. '
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    'MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE '
    'FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN '
    'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
_BSD_TWO = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions '
    'are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following '
    'disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following '
    'disclaimer in the documentation and/or other materials provided with the distribution.')
_BSD_THIRD = (
    '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived '
    'from this software without specific prior written permission.')
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    'LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE '
    'COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES '
    '(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
    'HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) '
    'ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
_GNU_NOTICE = (
    'This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as '
    'published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.')
_ISC = (
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that '
    'the above copyright notice and this permission notice appear in all copies.')

#: Texts by licence identifier: single lines, header notices, titles of long licences, and short licences whole.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-2.0": [_GNU_NOTICE.format(kind="General", version=2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU_NOTICE.format(kind="General", version=3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": [_GNU_NOTICE.format(kind="Affero General", version=3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "LGPL-2.1": [
        "This library is free software under the terms of the GNU Lesser General Public License, version 2.1.",
        _GNU_NOTICE.format(kind="Lesser General", version=2.1), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": [_GNU_NOTICE.format(kind="Lesser General", version=3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", _MIT_GRANT, f"MIT License {_MIT_GRANT} {_MIT_REST}"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "BSD-2-Clause": [f"{_BSD_TWO} {_BSD_REST}"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.",
                     f"{_BSD_TWO} {_BSD_THIRD} {_BSD_REST}", _BSD_THIRD],
    "ISC": [_ISC],
    "MPL-2.0": [
        "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = "[a-z0-9]+"
#: Bytes with A-Z lower-cased and a blank for every byte that is in no term.
_TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))
LICENCE_NAMES = ("LICENSE", "LICENCE", "COPYING", "NOTICE")
COMMENT = r"[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)"
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?: (?:OR|AND|WITH) [A-Za-z0-9.+-]+)*)"


def _low(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def template_terms(templates: dict[str, list[str]]) -> dict[tuple[str, int], Counter]:
    return {(name, i): Counter(re.findall(TERM, _low(text))) for name, texts in templates.items() for i, text in enumerate(texts)}


def marking_terms(vectors: dict[tuple[str, int], Counter], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which every line at or above *threshold* holds one: the heaviest of each template, until the rest cannot reach it.

    A line without them shares only the rest with the template, so its cosine is at most |rest| / |template|.
    """
    marks: set[str] = set()
    for terms in vectors.values():
        weight = {t: (n * idf[t])**2 for t, n in terms.items()}
        for term in sorted(weight, key=lambda t: (-weight[t], t)):
            if sum(w for t, w in weight.items() if t not in marks) < (threshold * 0.999)**2 * sum(weight.values()):
                break
            marks.add(term)
    return sorted(marks)


def documents_with(named: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term; summed per batch before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            held: Counter = Counter()
            for text in texts:
                held.update(set(text.encode("utf-8", "replace").translate(_TERM_BYTES).split()))
            yield record(term=pa.array([t.decode() for t in held], pa.string()), n=pa.array(list(held.values()), pa.int64()))

    return named.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def blocks_of(lines: list[str], bare: list[bool]) -> Iterator[tuple[int, int]]:
    """(first, after last) of each longest run of comment lines, or of other lines, that hold terms; *bare* marks those that do not."""
    kinds = [0 if empty else 1 if re.match(COMMENT, line) else 2 for line, empty in zip(lines, bare)]
    start = 0
    for i in range(1, len(kinds) + 1):
        if i == len(kinds) or kinds[i] != kinds[start]:
            if kinds[start]:
                yield start, i
            start = i


def _may_reach(terms: list[bytes], goals: list[dict[bytes, float]], idf: dict[bytes, float], threshold: float) -> bool:
    """Whether the cosine to any goal could reach *threshold* if all unknown terms had the least weight there is, one."""
    counts = Counter(terms)
    norm = math.sqrt(sum((n * idf.get(t, 1.0))**2 for t, n in counts.items()))
    return any(sum(n * idf[t] * goal[t] for t, n in counts.items() if t in goal) >= threshold * 0.999 * norm for goal in goals)


def candidates(named: DataFrame, vectors: dict[tuple[str, int], Counter], idf: dict[str, float], threshold: float) -> DataFrame:
    """(id, path, unit, spdx): the lines, blocks and whole licence files that may reach *threshold*, and declared identifiers.

    One of unit and spdx is null.  A unit that a file holds twice may come twice.
    """
    wanted = {m.encode() for m in marking_terms(vectors, idf, threshold)}
    weight = {t.encode(): x for t, x in idf.items()}
    goals = []
    for v in vectors.values():
        size = math.sqrt(sum((c * idf[t])**2 for t, c in v.items()))
        goals.append({t.encode(): c * idf[t] / size for t, c in v.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            owner, units, declared = [], [], []
            paths = rows.column(rows.schema.get_field_index("path")).to_pylist()

            def offer(i: int, unit: str, terms: list[bytes]) -> None:
                if not wanted.isdisjoint(terms) and _may_reach(terms, goals, weight, threshold):
                    owner.append(i)
                    units.append(unit)
                    declared.append(None)

            for i, text in enumerate(texts):
                if "SPDX-License-Identifier:" in text:
                    for name in set(re.findall(SPDX, text)):
                        owner.append(i)
                        units.append(None)
                        declared.append(name)
                terms = text.encode("utf-8", "replace").translate(_TERM_BYTES).split()
                if wanted.isdisjoint(terms):
                    continue
                if paths[i] is not None and paths[i].rsplit("/", 1)[-1] in LICENCE_NAMES:
                    offer(i, text, terms)
                lines = text.split("\n")
                held = [line.encode("utf-8", "replace").translate(_TERM_BYTES).split() for line in lines]
                for line, own in zip(lines, held):
                    offer(i, line, own)
                for first, last in blocks_of(lines, [not own for own in held]):
                    if last - first > 1:
                        offer(i, "\n".join(lines[first:last]), [t for own in held[first:last] for t in own])
            own_rows = rows.select(["id", "path"]).take(pa.array(owner, pa.int64()))
            yield record(id=own_rows.column("id"), path=own_rows.column("path"),
                         unit=pa.array(units, pa.string()), spdx=pa.array(declared, pa.string()))

    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(run, f"id {kind}, path string, unit string, spdx string")


def scan(files: DataFrame, id_column: str = "doc_id", path: str = "path", text: str = "text",
         templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, own_licence, own_score, licence, licence_from), one row per row of *files*.

    licence_from is the file's own path, that of the licence file it inherits from, or null.  Scores
    are rounded to six decimals; ties go to the licence and the path that sort first.  Null or empty texts
    have no licence of their own; a null path inherits nothing.  Rows that repeat id and path share
    the best result of any of them.  Texts of any length are compared whole.  Extra columns are not read.
    """
    spark = files.sparkSession
    vectors = template_terms(templates if templates is not None else TEMPLATES)
    vocabulary = sorted({t for v in vectors.values() for t in v})
    named = files.select(F.col(id_column).alias("id"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    held = settle(documents_with(named), "held")
    # Only the templates' own terms reach the driver.
    counted = {r.term: r.n for r in held.where(F.col("term").isin(vocabulary)).collect()}
    n = named.count()
    idf = {t: math.log((1 + n) / (1 + counted.get(t, 0))) + 1 for t in vocabulary}
    found = settle(candidates(named, vectors, idf, threshold), "marked")
    marked = found.where("unit IS NOT NULL")
    # A unit is scored once however often it occurs.
    counts = marked.select("unit").distinct().select("unit", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit", "term").count()
    goals = spark.createDataFrame(
        [(t, name, i, c * idf[t], math.sqrt(sum((m * idf[u])**2 for u, m in v.items()))) for (name, i), v in vectors.items() for t, c in v.items()],
        "term string, licence string, variant int, goal double, goal_norm double")
    weighed = settle(salted_join(counts, held, ["term"], "unit").select(
        "unit", "term", (F.col("count") * (F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1)).alias("w")), "weighed")
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # The goals hold the templates' terms only.
    dots = weighed.join(F.broadcast(goals), "term").groupBy("unit", "licence", "variant", "goal_norm").agg(F.sum(F.col("w") * F.col("goal")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "licence", F.round(F.col("dot") / F.col("norm") / F.col("goal_norm"), 6).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    declared = found.where("spdx IS NOT NULL").select("id", "path", F.struct(F.lit(-1.0).alias("s"), F.col("spdx").alias("licence")).alias("b"))
    own = (salted_join(marked, best, ["unit"], "id").select("id", "path", "b").unionByName(declared)
           .groupBy("id", "path").agg(F.min("b").alias("b"))
           .select("id", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("own_score")))
    # Licence files speak for their directory; of several the best, then the first path.
    folder = lambda p: F.regexp_replace(p, "[^/]*$", "")
    base = F.regexp_extract("path", "[^/]*$", 0)
    giving = (own.where(base.isin(*LICENCE_NAMES)).groupBy(folder(F.col("path")).alias("above"))
              .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_licence", "path")).alias("g")))
    # Every directory looks for the nearest one above it, itself first; files then ask their directory only.
    folders = named.where("path IS NOT NULL").select(folder(F.col("path")).alias("folder")).distinct()
    depth = F.size(F.split("folder", "/")) - 1
    ups = folders.select("folder", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select(
        "folder", "depth", F.when(F.col("depth") == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.greatest("depth", F.lit(1))), "/"), F.lit("/"))).alias("above"))
    nearest = ups.join(giving, "above").groupBy("folder").agg(F.max_by("g", "depth").alias("g"))
    placed = (named.select("id", "path").join(own.withColumnsRenamed({"id": "oid", "path": "opath"}),
             F.col("id").eqNullSafe(F.col("oid")) & F.col("path").eqNullSafe(F.col("opath")), "left")
             .withColumn("folder", folder(F.col("path"))))
    # Salted: one folder may hold a third of the files.
    return salted_join(placed, nearest, ["folder"], "id", how="left").select(
        F.col("id").alias(id_column), "path", "own_licence", "own_score", F.coalesce("own_licence", "g.own_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("g.path")).alias("licence_from"))


#: documents seen as files: a folder per source, in it per language, in it per thousand ids; some ids are licence
#: files at one of these levels.
PATH_SQL = ("source || '/' || CASE WHEN doc_id % 1000 = 7 THEN 'LICENSE' ELSE lang || '/' || CASE WHEN doc_id % 100 = 8 THEN 'COPYING' "
            "ELSE CAST(doc_id // 1000 AS VARCHAR) || '/' || CASE WHEN doc_id % 10 = 9 THEN 'LICENSE' ELSE CAST(doc_id AS VARCHAR) || '.txt' END END END")
PATH_SPARK = PATH_SQL.replace("doc_id // 1000", "doc_id div 1000").replace("VARCHAR", "STRING")


def _sql() -> str:
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    rows = ", ".join(f"('{t}', '{name}', {i}, {c})" for (name, i), v in template_terms(TEMPLATES).items() for t, c in v.items())
    names = ", ".join(f"'{x}'" for x in LICENCE_NAMES)
    return f"""
WITH template(term, licence, variant, n) AS (VALUES {rows}),
files AS (SELECT doc_id, {PATH_SQL} AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS docs FROM files),
held AS (
  SELECT term, count(*) AS df
  FROM (SELECT unnest(list_distinct(regexp_extract_all({low % 'text'}, '{TERM}'))) AS term FROM files) GROUP BY term),
idf AS (
  SELECT term, ln((1 + docs) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM template UNION SELECT term FROM held) LEFT JOIN held USING (term), total),
goal AS (
  SELECT term, licence, variant, n * idf AS goal, sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY licence, variant)) AS goal_norm
  FROM template JOIN idf USING (term)),
lines AS (
  SELECT doc_id, path, pos, l[pos] AS unit,
         CASE WHEN NOT regexp_matches({low % 'l[pos]'}, '{TERM}') THEN 0 WHEN regexp_matches(l[pos], '^{COMMENT}') THEN 1 ELSE 2 END AS kind
  FROM (SELECT doc_id, path, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, path, string_split(text, chr(10)) AS l FROM files))),
changes AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id, path ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM lines),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, path ORDER BY pos) AS run FROM changes),
units AS (
  SELECT doc_id, path, unit FROM lines
  UNION SELECT doc_id, path, string_agg(unit, chr(10) ORDER BY pos) FROM runs WHERE kind > 0 GROUP BY doc_id, path, run
  UNION SELECT doc_id, path, text FROM files WHERE regexp_extract(path, '[^/]*$') IN ({names})),
counts AS (
  SELECT unit, term, count(*) AS n
  FROM (SELECT unit, unnest(regexp_extract_all({low % 'unit'}, '{TERM}')) AS term FROM (SELECT DISTINCT unit FROM units)) GROUP BY unit, term),
weighed AS (SELECT unit, term, n * idf AS w FROM counts JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY unit),
scored AS (
  SELECT unit, licence, round(sum(w * goal) / any_value(norm) / any_value(goal_norm), 6) AS score
  FROM weighed JOIN goal USING (term) JOIN norms USING (unit) GROUP BY unit, licence, variant),
own AS (
  SELECT doc_id, path, licence AS own_licence, score AS own_score
  FROM (SELECT doc_id, path, licence, score FROM units JOIN scored USING (unit) WHERE score >= {THRESHOLD}
        UNION ALL SELECT doc_id, path, unnest(regexp_extract_all(text, '{SPDX}', 1)), 1.0 FROM files)
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, licence) = 1),
giving AS (
  SELECT regexp_replace(path, '[^/]*$', '') AS above, own_licence, path
  FROM own WHERE regexp_extract(path, '[^/]*$') IN ({names})
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '[^/]*$', '') ORDER BY own_score DESC, own_licence, path) = 1),
nearest AS (
  SELECT f.folder, g.own_licence, g.path
  FROM (SELECT DISTINCT regexp_replace(path, '[^/]*$', '') AS folder FROM files) f JOIN giving g ON starts_with(f.folder, g.above)
  QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(g.above) DESC) = 1)
SELECT f.doc_id, f.path, o.own_licence, o.own_score, coalesce(o.own_licence, n.own_licence) AS licence,
       CASE WHEN o.own_licence IS NOT NULL THEN f.path ELSE n.path END AS licence_from
FROM files f LEFT JOIN own o ON f.doc_id = o.doc_id AND f.path = o.path
LEFT JOIN nearest n ON n.folder = regexp_replace(f.path, '[^/]*$', '')
"""


SQL = _sql()
