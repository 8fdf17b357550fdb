"""How far each source of a language strays from the others, and by which terms, ranked by cells of counts.

The value of a term depends on two counts only: its count in the group and its count in what the group is
held against.  So terms are put into cells by the pair of counts; a value is worked out once a cell, exactly,
in whole numbers.  Cells of equal value are one step of the ranking, whose place follows from how many terms
stand before it; only the steps that reach the wanted ranks are expanded into terms, in UTF-8 order.

Pairs of sources are compared in blocks: a task holds two blocks of sources and a slice of the terms, puts
the slice's terms into cells for each pair of sources, and gives one sum a pair.  Terms that neither source
of a pair has are all in one cell and are counted, not listed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.tables import record
from meterline.session import settle

#: A document's terms: runs of ASCII letters and of characters that are not ASCII.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms a counting task holds before it sends them on; sources of a block and terms of a slice in a comparison.
HELD, SOURCES, TERMS = 200_000, 64, 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of runs of rows; a term can come again, for the sum behind the shuffle."""
    find = re.compile(TERM).findall
    held: defaultdict[tuple[str, str], defaultdict[bytes, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    size = 0

    def sent() -> pa.RecordBatch:
        rows = [(lang, source, t, n, d) for (lang, source), own in held.items() for t, (n, d) in own.items()]
        lang, source, term, n, docs = zip(*rows)
        return record(lang=pa.array(lang, pa.string()), source=pa.array(source, pa.string()), term=pa.array(term, pa.binary()).cast(pa.string()),
                      n=pa.array(n, pa.int64()), docs=pa.array(docs, pa.int64()))

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            own = held[lang, source]
            before = len(own)
            for term, n in Counter(find(text.translate(_LOWER))).items():
                entry = own[term]
                entry[0] += n
                entry[1] += 1
            size += len(own) - before
            if size > HELD:
                yield sent()
                held.clear()
                size = 0
    if size:
        yield sent()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents (rows) that hold it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))],
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals: no count is too large."""
    whole = [c.cast("decimal(19,0)") for c in (count, total, terms)]
    over = (whole[0] + 2) * F.lit(SCALE).cast("decimal(10,0)")
    of = F.greatest(whole[1] + whole[2] * 2, F.lit(1).cast("decimal(21,0)"))  # a language without terms has no shares to speak of
    return F.call_function("div", over, of) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _vocabulary(counts: DataFrame, least: int) -> DataFrame:
    return (counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs"))
            .where(F.col("all_docs") >= least).select("lang", "term", "all_n"))


def _top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of each group's terms that are more frequent in it than in its language."""
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "n", "all_n").agg(F.count(F.lit(1)).alias("many"))
    sized = cells.join(groups, group)
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    valued = sized.select(*group, "n", "all_n", "many", p.alias("p"), q.alias("q")).where("p > q")
    valued = settle(valued.select(*group, "n", "all_n", "many", _gap(F.col("p"), F.col("q")).alias("value")), "cells")
    # A step of the ranking is a value; no more than *top* steps can matter, as each holds a term at least.
    order = Window.partitionBy(*group).orderBy(F.desc("value"))
    steps = (valued.groupBy(*group, "value").agg(F.sum("many").alias("many")).withColumn("step", F.row_number().over(order))
             .where(F.col("step") <= top))
    ahead = F.sum("many").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < top)
    wanted = valued.drop("many").join(steps.select(*group, "value", "ahead"), [*group, "value"])
    # A step may hold any number of terms: only its first ones in UTF-8 order leave the tasks that read them.
    within = Window.partitionBy(*group, "value", "ahead").orderBy("term")
    named = (kept.join(settle(wanted, "steps"), [*group, "n", "all_n"])
             .select(*group, "value", "ahead", "term", F.row_number().over(within).alias("k")).where(F.col("k") <= top))
    rank = F.col("ahead") + F.col("k")
    return named.where(rank <= top).select(*group, F.col("term").alias("item"), "value", rank.cast("int").alias("rank"))


def _compare(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Sums of one slice of terms over all pairs of a source of block *a* and a later one of block *b*."""
    lang, _, a, b = key
    marks = block[block.term.isna()].drop_duplicates("source").sort_values("source", kind="stable")
    names, zero, home = marks.source.tolist(), marks.p.to_numpy(np.int64), marks.home.to_numpy()
    rows = block[block.term.notna()]
    place = {name: i for i, name in enumerate(names)}
    term, terms = pd.factorize(rows.term)
    shares = np.repeat(zero[:, None], len(terms), axis=1)
    shares[rows.source.map(place).to_numpy(np.int64) if len(rows) else [], term] = rows.p.to_numpy(np.int64)
    coded = [np.unique(row, return_inverse=True) for row in shares]
    out = []
    for i, j in ((i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if {home[i], home[j]} == {a, b}):
        (p, u), (q, v) = coded[i], coded[j]
        cells, many = np.unique(u * len(q) + v, return_counts=True)
        p, q = p[cells // max(len(q), 1)], q[cells % max(len(q), 1)]
        out.append((lang, names[i], names[j], int(((p - q) ** 2 // (p + q) * many).sum()), len(terms)))
    return pd.DataFrame(out, columns=["lang", "one", "two", "value", "seen"])


def _pairs(kept: DataFrame, groups: DataFrame, sources: int, terms: int) -> DataFrame:
    """(lang, source, item, value, rank) of all ordered pairs of sources of a language."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / sources).cast("int").alias("blocks"), F.ceil(F.greatest(F.max("terms"), F.lit(1)) / terms).cast("int").alias("slices"))
    none = F.lit(0).cast("long")
    zero = _share(none, F.col("total"), F.col("terms"))
    groups = settle(groups.join(sizes, "lang").withColumn("home", F.pmod(F.xxhash64("source"), F.col("blocks").cast("long"))).withColumn("zero", zero), "groups")
    own = (kept.join(groups, ["lang", "source"])
           .select("lang", "source", "home", "blocks", "term", F.pmod(F.xxhash64("term"), F.col("slices").cast("long")).alias("slice"),
                   _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")))
    marks = groups.select("lang", "source", "home", "blocks", F.lit(None).cast("string").alias("term"),
                          F.explode(F.sequence(none, F.col("slices").cast("long") - 1)).alias("slice"), F.col("zero").alias("p"))
    dealt = own.union(marks).select("*", F.explode(F.sequence(none, F.col("blocks").cast("long") - 1)).alias("other"))
    dealt = dealt.select("lang", "slice", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"), "source", "home", "term", "p")
    sums = dealt.groupBy("lang", "slice", "a", "b").applyInPandas(_compare, "lang string, one string, two string, value long, seen long")
    sums = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    for end in ("one", "two"):
        sums = sums.join(groups.select("lang", F.col("source").alias(end), F.col("zero").alias(f"zero_{end}"), F.col("terms").alias(f"terms_{end}")), ["lang", end])
    value = F.col("value") + (F.col("terms_one") - F.col("seen")) * _gap(F.col("zero_one"), F.col("zero_two"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("x")
    flat = sums.select("lang", value.alias("value"), both).select("lang", "x.source", "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return flat.withColumn("rank", F.row_number().over(order)).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCUMENTS, lang: str = "lang", source: str = "source", text: str = "text",
          sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module; ranks from 1 by value descending and item ascending.

    Part "pair" has every other source of the language, part "term" the *top* terms that the group has more
    of than its language.  Terms are kept if *least* documents of the language hold them; shares are smoothed
    and scaled whole numbers, and all arithmetic is exact.  A null text, language or source is the empty
    string; groups without terms take part; with no kept terms all pairs have value 0; a language of one
    source has no pairs; repeated rows count again; an empty table has no rows; extra columns are not read.

    No group is gathered: counts of a source meet first in the task that reads them, its terms then spread by
    (lang, term), its cells by their counts, its comparisons by slices of *terms* terms for two blocks of
    about *sources* sources.  A window holds one source's steps, *top* at most, or its pairs.
    """
    counts = settle(term_counts(docs, lang, source, text), "terms")
    kept = settle(counts.join(_vocabulary(counts, least), ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "kept")
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    found = docs.select(*group).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = (_vocabulary(counts, least).groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count(F.lit(1)).alias("terms")))
    none = F.lit(0).cast("long")
    groups = settle(found.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
                    .select("lang", "source", *[F.coalesce(F.col(c), none).alias(c) for c in ("total", "all_total", "terms")]), "groups")
    pairs = _pairs(kept, groups, sources, terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    named = _top_terms(kept, groups, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(named)


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM terms GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sizes AS (SELECT lang, source, sum(c) AS n, count(*) AS v FROM grid GROUP BY lang, source),
shares AS (SELECT lang, source, term, c, CAST(1 + 1000000000 * (c + 2) // (n + 2 * v) AS HUGEINT) AS p FROM grid JOIN sizes USING (lang, source)),
whole AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang),
lang_shares AS (SELECT lang, term, CAST(1 + 1000000000 * (c + 2) // (n + 2 * v) AS HUGEINT) AS q FROM kept JOIN whole USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((s.p - t.p) * (s.p - t.p) // (s.p + t.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares s ON s.lang = a.lang AND s.source = a.source LEFT JOIN shares t ON t.lang = b.lang AND t.source = b.source AND t.term = s.term
  GROUP BY ALL),
term AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
