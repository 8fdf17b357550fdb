"""Fill-in-the-middle rewriting, with cuts found through a sparse index of the characters that are not ASCII.

A text is bytes.  Only the places of its multibyte characters are recorded, with the bytes they take beyond
one; between two of them a code point is a byte, so a cut is turned from code points into bytes, or back, by
one searchsorted and a sum.  Nothing is decoded, and a text of ASCII has an empty index.

Middle and suffix change places behind marks: prefix, suffix, middle ("psm") or suffix, prefix, middle
("spm").  Where the text holds a mark itself, or is empty, or is not drawn, it stays as it is ("plain"), so
the text can always be rebuilt from output and form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.tables import record

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are cut together; a longer text is alone.
PIECE = 4_000_000


@dataclass(frozen=True)
class CharIndex:
    """Where the multibyte characters of a byte array start, and the excess bytes of all before each."""

    starts: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> CharIndex:
        starts = np.flatnonzero(data >= 0xC0)
        lead = data[starts]
        own = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        return cls(starts, np.concatenate([[0], np.cumsum(own)]))

    def chars(self, places: np.ndarray) -> np.ndarray:
        """Code points before each byte place; places are where characters start, or the end."""
        return places - self.excess[np.searchsorted(self.starts, places)]

    def places(self, chars: np.ndarray) -> np.ndarray:
        """Byte place of each code point, counted from the start of the array."""
        return chars + self.excess[np.searchsorted(self.starts - self.excess[:-1], chars)]


def cut_places(data: np.ndarray, ends: np.ndarray, draws: tuple[np.ndarray, np.ndarray], unit: str = "line"):
    """(units, first cut, second cut, index) of the texts that end at *ends* in *data*; cuts are byte places."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    index = CharIndex.of(data)
    if unit == "line":
        breaks = np.flatnonzero(data == 10) + 1
        first = np.searchsorted(breaks, starts, "right")
        full = np.searchsorted(breaks, ends, "right") - first
        last = np.where(full > 0, breaks[np.minimum(first + full, len(breaks)) - 1] if len(breaks) else 0, starts)
        n = full + (last < ends)
    elif unit == "char":
        before = index.chars(starts)
        n = index.chars(ends) - before
    else:
        raise ValueError(f"unknown unit {unit!r}: line or char")
    one, two = (d % (n + 1) for d in draws)

    def place(k: np.ndarray) -> np.ndarray:
        if unit == "char":
            return index.places(before + k)
        inner = breaks[np.clip(first + k - 1, 0, len(breaks) - 1)] if len(breaks) else starts
        return np.where(k == 0, starts, np.where(k <= full, inner, ends))

    return n, place(np.minimum(one, two)), place(np.maximum(one, two)), index


def _pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, end of each text) of a binary column, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        yield a, b, data[ends[a]:ends[b]], ends[a + 1:b + 1] - ends[a]
        a = b


def _kernel(unit: str, rate: int, spm: int, limit: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in _pieces(batch.column("text"), limit):
                h1, h2, h3, h4 = (batch.column(h)[a:b].to_numpy(zero_copy_only=False) for h in ("h1", "h2", "h3", "h4"))
                n, one, two, index = cut_places(data, ends, (h1, h2), unit)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                drawn = (n > 0) & (h3 % 100 < rate)
                whole = data.tobytes()
                out, form = [], []
                for i, (s, p, q, e) in enumerate(zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist())):
                    if not drawn[i] or any(whole.find(m, s, e) >= 0 for m in marks):
                        out.append(whole[s:e])
                        form.append("plain")
                    elif h4[i] % 100 < spm:
                        out.append(b"".join((marks[1], whole[q:e], marks[0], whole[s:p], marks[2], whole[p:q])))
                        form.append("spm")
                    else:
                        out.append(b"".join((marks[0], whole[s:p], marks[1], whole[q:e], marks[2], whole[p:q])))
                        form.append("psm")
                plain = np.array([f == "plain" for f in form], bool)
                chars = index.chars(np.stack([starts, one, two]))
                yield record(id=batch.column("id")[a:b], n=n.astype(np.int64), form=form,
                             prefix_chars=pa.array(chars[1] - chars[0], mask=plain), middle_chars=pa.array(chars[2] - chars[1], mask=plain),
                             output=pa.array(out, pa.binary()).cast(pa.string()))

    return rewrite


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7,
                   id_column: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per document, without a shuffle.

    *unit* is what is counted and never cut: "line" (a line with its line feed, or what follows the last
    one) or "char".  *rate* percent of the texts are rewritten, *spm* percent of those suffix first.  All
    draws come from sha256 of "seed:id", so a repeated task gives the same rows and repeated rows are cut
    alike.  A null text is empty and so plain; a null id draws as the empty string; a single unit, or equal
    draws, gives empty parts.  Lengths are code points, null where plain.  A very long text is a piece of
    its own; extra columns are not read, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("*", *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    done = rows.mapInArrow(_kernel(unit, rate, spm, piece),
                           f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return done.withColumnRenamed("id", id_column)


def restored(output: Column, form: Column) -> Column:
    """The text as it was: a rewritten one holds each mark once, so they part it without doubt."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, middle, second))
            .when(form == "spm", F.concat(second, middle, first)).otherwise(output))


def digests(docs: DataFrame, **options) -> DataFrame:
    """`fill_in_middle` with sha256 of the output and of the text rebuilt from it in place of the output."""
    out = F.col("output")
    return fill_in_middle(docs, **options).withColumns({
        "output_sha256": F.sha2(out, 256), "restored_sha256": F.sha2(restored(out, F.col("form")), 256)}).drop("output")


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM units),
cut AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 100 THEN 'plain'
              WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
