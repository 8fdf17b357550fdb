"""Removing repeated substrings by a suffix sort over a difference cover.

Texts are byte strings; a window is LENGTH bytes; a window that also starts elsewhere is repeated.

The cover.  Two equal windows hold the same least k-gram (by hash), at the same distance from their
starts.  So the places of the least k-grams are a difference cover: for any two equal windows at i and
j there is a d below the cover's period with both i + d and j + d in it - and few places are needed,
about two a period.  Only places whose k-gram occurs twice need sorting at all; and occurrences with
the same surroundings are one class, sorted once, whose windows are all repeated if it has two members.

The sort.  A suffix bucket is all windows whose cover place holds the same k-gram.  Buckets are sorted a
bounded block at a time: the suffixes that start at the cover places are ranked with their common
prefixes, and so are the (short, less than a period) stretches before them, read backwards.  A window d
bytes before its cover place then has its ties resolved by two precomputed ranks, for every d, without
ever comparing 400 bytes again.

Hot buckets.  A bucket of more classes than one task should sort is compared by hashes, which are counted
before they are shuffled: first the bytes that windows of neighbouring distances share, then the windows
one by one where those bytes occur twice.  So no task holds a bucket, however many rows it has.  Surroundings
and windows that are told apart by hashes have 128 bits of two independent ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.tables import pieces, record
from meterline.llm.words import Prefixes, joined_bytes, mix
from meterline.session import settle

LENGTH = 400
#: Characters whose cover places are found at once: some twenty numbers of 64 bits each are held meanwhile.
PLACES = 500_000
#: Classes in a block of suffix buckets, the size from which the windows of one bucket are hashed instead, and the
#: distances that such windows are first compared by together.
BLOCK, HOT, STRIP = 8192, 50_000, 16


def _gram(length: int) -> int:
    """Bytes of the grams that choose cover places: the period is length - gram + 1."""
    return max(1, length * 3 // 8)


def cover_places(texts: list[str], length: int) -> dict[str, np.ndarray]:
    """Cover places of all windows: text, hash of the gram, two hashes of the surroundings, first window, further windows, distance."""
    data, ends = joined_bytes(texts)
    k, n = _gram(length), len(data)
    period = length - k + 1
    none = np.zeros(0, np.int64)
    if n < length + 1:
        return dict(text=none, gram=none, around=none, beyond=none, first=none, more=none, back=none)
    prefixes = Prefixes(data)
    at = np.arange(n - k + 1)
    gram = prefixes.of(at, at + k)
    # The order of grams; ties go to the leftmost, which the low bits say.
    low = np.uint64(32)  # the same for every piece: the order of grams must not hang on what they are read with
    if n >= 2**32:
        raise ValueError("a text of 4 GB or more")
    key = gram >> low << low | at.astype(np.uint64)
    rows = -(-len(key) // period)
    grid = np.full(rows * period, 2**64 - 1, np.uint64)
    grid[:len(key)] = key
    grid = grid.reshape(rows, period)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - length + 1)
    text = np.searchsorted(ends, start)
    start = start[start + length <= ends[text]]
    if not len(start):
        return dict(text=none, gram=none, around=none, beyond=none, first=none, more=none, back=none)
    place = (np.minimum(behind[start], ahead[start + period - 1]) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last, place = start[new], start[np.append(new[1:], len(start)) - 1], place[new]
    text = np.searchsorted(ends, first)
    begin = np.concatenate([[0], ends[:-1] + 1])[text]
    shape = (place - first).astype(np.uint64) * np.uint64(3) + (last - first).astype(np.uint64)
    around, beyond = (mix(p.of(first, last + length) + shape) for p in (prefixes, Prefixes(data, other=True)))
    return dict(text=text, gram=gram[place].view(np.int64), around=around.view(np.int64), beyond=beyond.view(np.int64),
                first=first - begin, more=last - first, back=place - first)


def _common(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; rows are padded, *size* are their lengths."""
    differs = a[1:] != a[:-1]
    first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    return np.concatenate([[0], np.minimum(first, np.minimum(size[1:], size[:-1]))])


def _ranked(bucket: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string within the sorted (bucket, string), common prefix with the one before, -1 in another bucket)."""
    keys = list(zip(bucket.tolist(), strings))
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    size = np.array([len(s) for s in strings], np.int64)[order]
    width = max(1, int(size.max(initial=1)))
    common = np.zeros(len(order), np.int64)
    for i in range(0, len(order), 4096):
        part = order[max(0, i - 1):i + 4096]
        grid = np.frombuffer(b"".join(strings[j].ljust(width, b"\0") for j in part.tolist()), np.uint8).reshape(len(part), width)
        common[max(0, i - 1) + (i > 0):i + 4096] = _common(grid, size[max(0, i - 1):i + 4096])[1 if i else 0:]
    common[np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])] = -1
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, common


def repeated_windows(bucket: np.ndarray, left: list[bytes], right: list[bytes], nearest: np.ndarray, length: int) -> np.ndarray:
    """For each row and distance d, whether the window d before its cover place equals one of another row of its bucket.

    *left* ends and *right* begins at the place; the row's windows have distances nearest to len(left).
    """
    farthest = np.array([len(x) for x in left], np.int64)
    left_rank, left_common = _ranked(bucket, [x[::-1] for x in left])
    right_rank, right_common = _ranked(bucket, right)
    found = np.zeros((len(left), int(farthest.max(initial=0)) + 1), bool)
    for d in range(found.shape[1]):
        rows = np.flatnonzero((nearest <= d) & (d <= farthest))
        if len(rows) < 2:
            continue
        a = np.cumsum(left_common < d)[left_rank[rows]]
        b = np.cumsum(right_common < length - d)[right_rank[rows]]
        key = a * (len(left) + 1) + b
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        found[rows[order[hit]], d] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


_KEYS = "id long, version long"
_PLACE_KEYS = ["id", "version", "at"]


def _twice(strips: DataFrame, name: str) -> DataFrame:
    """Rows of *strips* whose (bucket, lo, key, other) occurs twice; as for grams, both sides are written, so that a hot key can be split."""
    keys = ["bucket", "lo", "key", "other"]
    stored = settle(strips, name)
    many = settle(stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), f"{name}-twice")
    return stored.join(many, keys).select(*_PLACE_KEYS, "lo")


def _hashed_windows(rows: DataFrame, length: int) -> DataFrame:
    """(id, version, start, stop): windows of *rows* that equal one of another row of their bucket, found without gathering a bucket."""
    strip = min(STRIP, length)

    def hashed(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 2048):
                    part = whole.slice(begin, 2048)
                    left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
                    far = np.array([len(x) for x in left], np.int64)
                    size = far + np.array([len(x) for x in right], np.int64)
                    place = np.cumsum(size) - size + far
                    data = np.frombuffer(b"".join(x for two in zip(left, right) for x in two), np.uint8)
                    # Strips are aligned, so rows agree on them; a strip may reach over either end of a row's distances.
                    low = part.column("near").to_numpy() // width
                    if "strips" in part.schema.names:
                        given = part.column("strips").to_pylist()
                        row = np.repeat(np.arange(len(far)), [len(g) for g in given])
                        lo = (np.array([x for g in given for x in g], np.int64)[:, None] + np.arange(strip)).ravel()
                        row = np.repeat(row, strip)
                        inside = (lo >= part.column("near").to_numpy()[row]) & (lo <= far[row])
                        row, lo = row[inside], lo[inside]
                    else:
                        n = far // width - low + 1
                        row = np.repeat(np.arange(len(far)), n)
                        lo = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]) * width
                    key, other = (Prefixes(data, o).of(place[row] - lo, place[row] - lo - (width - 1) + length).view(np.int64) for o in (False, True))
                    yield record(**{c: part.column(c).take(pa.array(row)) for c in ("id", "version", "at", "bucket")}, lo=lo, key=key, other=other)
        return run

    schema = f"{_KEYS}, at long, bucket long, lo long, key long, other long"
    strips = _twice(rows.mapInArrow(hashed(strip), schema), "strips").groupBy(*_PLACE_KEYS).agg(F.collect_list("lo").alias("strips"))
    windows = _twice(rows.join(strips, _PLACE_KEYS).mapInArrow(hashed(1), schema), "windows")
    return windows.select("id", "version", (F.col("at") - F.col("lo")).alias("start"), (F.col("at") - F.col("lo") + length).alias("stop"))


def repeated_spans(texts_: DataFrame, length: int = LENGTH, dealt: DataFrame | None = None) -> DataFrame:
    """(id, version, spans): byte ranges [start, stop) covered by repeated windows, for documents that have any.

    *texts_* has (id, version, text); version tells apart rows that repeat an id.  *dealt* is the
    same table dealt by its key, if the caller joins the spans to it.
    """
    limit = PLACES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, limit=limit):
            got = cover_places(texts, length)
            own = rows.select(["id", "version"]).take(pa.array(got.pop("text")))
            yield record(id=own.column("id"), version=own.column("version"), **got)

    cover = settle(texts_.mapInArrow(places, f"{_KEYS}, gram long, around long, beyond long, first long, more long, back long"), "cover")
    # Grams that occur twice; combined before the shuffle, so a gram of all documents costs one row a task.
    # What is joined is written first: with an exchange of its own on either side, Spark can split a hot key.
    twice = settle(cover.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("a0"), F.max("around").alias("a1"),
                                             F.min("beyond").alias("b0"), F.max("beyond").alias("b1"))
                   .where("n > 1").select("gram", F.expr("a0 != a1 OR b0 != b1").alias("several")), "grams")
    ranked = settle(cover.join(twice, "gram"), "repeated")
    place, own = F.struct("id", "version", "first", "more", "back"), ["gram", "around", "beyond"]
    classes = settle(ranked.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"), F.first("several").alias("several")), "classes")
    # A class of two or more: every window of it is repeated, whatever the other classes hold.
    crowd = classes.where("n > 1").select(*own)
    whole = ranked.join(crowd, own).select(
        "id", "version", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("stop"))
    # Buckets of several classes are sorted, one row a class.
    alone = classes.where("several")
    busy = settle(alone.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")), "buckets")
    chosen = settle(alone.join(busy, "gram").select("gram", "n", "p.*", (F.col("classes") > HOT).alias("hot")), "chosen")
    blocks = max(1, -(-chosen.count() // BLOCK))
    listed = chosen.groupBy("id", "version").agg(F.collect_list(F.struct("gram", "first", "more", "back", "hot")).alias("places"))

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            out: list[tuple] = []
            for key, version, places_, text in zip(rows.column("id").to_pylist(), rows.column("version").to_pylist(), rows.column("places").to_pylist(), texts):
                data = text.encode("utf-8", "replace")
                for p in places_:
                    at, stop = p["first"] + p["back"], p["first"] + p["more"] + length
                    out.append((key, version, p["hot"], at, p["gram"], p["back"] - p["more"], data[p["first"]:at], data[at:stop]))
            columns = list(zip(*out)) if out else [[]] * 8
            yield record(**{n: pa.array(c, t) for n, c, t in zip(
                ("id", "version", "hot", "at", "bucket", "near", "left", "right"), columns,
                (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    # The texts are dealt by their key once; the last step of the caller reads the same exchange.
    bytes_ = (texts_ if dealt is None else dealt).join(listed, ["id", "version"]).mapInArrow(
        surroundings, f"{_KEYS}, hot boolean, at long, bucket long, near long, left binary, right binary")
    any_hot = chosen.where("hot").limit(1).count() > 0
    if any_hot:
        bytes_ = settle(bytes_, "surroundings")

    def sort_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "id", "version", "at"], ignore_index=True)
        found = repeated_windows(rows.bucket.to_numpy(), rows.left.tolist(), rows.right.tolist(), rows.near.to_numpy(), length)
        out = [(rows.id.iat[i], rows.version.iat[i], rows["at"].iat[i], a, b) for i in np.flatnonzero(found.any(1)).tolist() for a, b in _runs(found[i])]
        return pd.DataFrame(out, columns=["id", "version", "at", "a", "b"], dtype="int64")

    # Distances a to b - 1 before the place: windows from at - b + 1 to at - a.
    single = (bytes_.where("NOT hot").drop("hot").withColumn("block", F.pmod(F.xxhash64("bucket"), F.lit(blocks))).groupBy("block")
              .applyInPandas(sort_block, f"{_KEYS}, at long, a long, b long")
              .select("id", "version", (F.col("at") - F.col("b") + 1).alias("start"), (F.col("at") - F.col("a") + length).alias("stop")))
    if any_hot:
        single = single.union(_hashed_windows(bytes_.where("hot"), length))
    # A set: rows that repeat id and text have the same spans, however many such rows there are.
    return whole.union(single).groupBy("id", "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def keyed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, text) of *docs*: null texts are empty; rows without an id are known by two hashes of their texts."""
    key, version, whole = _row_key(id_column, text)
    return docs.select(key.alias("id"), version.alias("version"), whole.alias("text"))


def _row_key(id_column: str, text: str) -> tuple[Column, Column, Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.col(id_column).cast("long"), F.xxhash64(whole, F.lit("no id"))), F.xxhash64(whole), whole


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans as disjoint runs; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def kept_parts(data: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    return [data[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(data)])]


def removal_digests(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_text), one row per row of *docs*.

    Every byte covered by a *length*-byte string that also starts anywhere else is removed, judged on
    the input.  Rows that repeat id and text are copies of each other.  Texts shorter than *length*,
    empty or null ones lose nothing.  The digest is of the bytes that remain; in the kept text a character
    of which a byte is removed goes as a whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for spans, text_ in zip(rows.column("spans").to_pylist(), texts):
                data, runs = text_.encode("utf-8", "replace"), merged(spans)
                gone, parts = sum(b - a for a, b in runs), kept_parts(data, runs)
                kept = "".join(p.decode("utf-8", "ignore") for p in parts)
                for column, value in zip(out, (len(data), gone, len(runs), hashlib.sha256(b"".join(parts)).hexdigest(), kept)):
                    column.append(value)
            yield record(id=rows.column("own"), n_bytes=pa.array(out[0], pa.int64()), n_removed=pa.array(out[1], pa.int64()),
                         n_spans=pa.array(out[2], pa.int64()), kept_sha256=pa.array(out[3], pa.string()), kept_text=pa.array(out[4], pa.string()))

    key, version, whole = _row_key(id_column, text)
    rows = docs.select(F.col(id_column).alias("own"), key.alias("id"), version.alias("version"), whole.alias("text")).repartition("id", "version")
    kind = docs.schema[id_column].dataType.simpleString()
    found = rows.join(repeated_spans(keyed(docs, id_column, text), length, rows.drop("own")), ["id", "version"], "left").mapInArrow(
        run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return found.withColumnRenamed("id", id_column)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """*docs* with the repeated bytes taken out of the text; other columns stay as they are.

    A character of which a byte is removed goes as a whole.  Rows stay, even if nothing of a text is left.
    """
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, text):
            out = []
            for spans, own, old in zip(rows.column("__spans").to_pylist(), texts, rows.column(text).to_pylist()):
                runs = merged(spans)
                out.append("".join(p.decode("utf-8", "ignore") for p in kept_parts(own.encode("utf-8", "replace"), runs)) if runs else old)
            at = names.index(text)
            columns = [rows.column(n) for n in names]
            columns[at] = pa.array(out, rows.column(text).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    key, version, _ = _row_key(id_column, text)
    tagged = docs.withColumn("__id", key).withColumn("__version", version)
    spans = repeated_spans(keyed(docs, id_column, text), length).select(
        F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("spans").alias("__spans"))
    return tagged.join(spans, ["__id", "__version"], "left").select(*names, "__spans").mapInArrow(run, schema)
