"""Text probabilities from a log-frequency Bloom filter that is learned once, stored, and probed by texts.

Counts of word pairs are quantised on a roughly logarithmic scale; a pair is put into the filter once
for each step its count reaches, and a probe climbs the steps until one is missing.  The filter is cut
into segments by ranges of the pair's hash, as many as the corpus needs, and every pair is kept.

`learn` writes a model: rows of filter segments, and rows of words with their exact counts.  `score`
sends the distinct words and pairs of any texts to the segments of their hashes and puts the answers
together; it sees no count but those the model gives back.  No task or driver holds the whole filter.

A token's probability mixes the pair's share of its context with the smoothed frequency of the word:
    weight * count(v, w) / count(v) + (1 - weight) * (count(w) + add) / (N + add * (V + 1)).
Quantised counts never exceed the true ones, so the mixture sums to at most one, but for false hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.tables import pieces, record
from meterline.llm.words import hashed_words, mix
from meterline.session import settle

#: The end of a text as a token.
END = np.uint64(0x5851F42D4C957F2D)
#: Count steps.
STEPS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536,
                  1 << 18, 1 << 20, 1 << 24, 1 << 28, 1 << 32, 1 << 40])
BITS_PER_ENTRY, PROBES = 10, 4
WEIGHT = 0.15
ADD = 0.1
#: Tokens in a chunk, unless a text has more, and tokens per segment: a chunk sends a row to every segment, so segments are large.
CHUNK, PER_SEGMENT = 500_000, 2_000_000
#: Pairs are told apart by the upper 48 bits of their hash.
_SPARE = np.uint64(16)
_WORDS, _PAIRS = 0, 1


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every token, hash of the one before it, tokens per text); the end stands before a text's first."""
    words, count = hashed_words(texts)
    count = count + 1
    ends = np.cumsum(count) - 1
    every = np.full(int(count.sum()), END, np.uint64)
    inside = np.ones(len(every), bool)
    inside[ends] = False
    every[inside] = words
    before = np.concatenate([[END], every[:-1]]) if len(every) else every
    return every, before.astype(np.uint64), count


def pair_keys(before: np.ndarray, every: np.ndarray) -> np.ndarray:
    return mix(mix(before * np.uint64(3)) + every) >> _SPARE << _SPARE


def segments_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each key, by ranges: sorted keys have sorted segments."""
    return ((keys >> np.uint64(40)) * np.uint64(segments) >> np.uint64(24)).astype(np.int64)


def _places(keys: np.ndarray, step: int, size: int) -> Iterator[np.ndarray]:
    """Bits of the probes within a segment of *size* bits, one probe of every key after the other."""
    a = mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (2 * step + 1) % 2**64))
    b = (a >> np.uint64(32)) | np.uint64(1)
    return ((a + np.uint64(i) * b) % np.uint64(size) for i in range(PROBES))


def filled_segment(keys: np.ndarray, counts: np.ndarray, bits: int = BITS_PER_ENTRY) -> bytes:
    """A segment of the filter: each key, counted at least once, is entered for every step up to its count."""
    steps = np.searchsorted(STEPS, counts, "right") - 1
    size = -(-int((steps + 1).sum()) * bits // 8) * 8
    out = np.zeros(size, np.uint8)
    for step in range(int(steps.max(initial=-1)) + 1):
        for place in _places(keys[steps >= step], step, size):
            out[place.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def probed_segment(data: bytes, keys: np.ndarray) -> np.ndarray:
    """How many steps the segment shows for each key, 0 where it does not have it; never less than were entered."""
    out = np.zeros(len(keys), np.uint8)
    bits = np.frombuffer(data, np.uint8)
    left = np.arange(len(keys) if len(bits) else 0)
    for step in range(len(STEPS)):
        if not len(left):
            break
        hit = np.ones(len(left), bool)
        for place in _places(keys[left], step, len(bits) * 8):
            hit &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        left = left[hit]
        out[left] = step + 1
    return out


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _plain(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True)


def _planes(values: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones, and so on: high bytes of small numbers are nearly all zero."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps, which are smaller the more keys there are."""
    return _packed(_planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8")))


def _plain_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(_plain(data, 8 * n), "<u8"), dtype=np.uint64)


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, train_tokens, ids, held_out, count, words, n_words, token): texts of *docs* (id, held_out, text), some in a row.

    words are the sorted hashes of the distinct tokens, token the place of every token among them, both packed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every, count, ids, held = zip(*waiting)
            words, token = np.unique(np.concatenate(every), return_inverse=True)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            count_, held_ = np.concatenate(count), pa.concat_arrays(held)
            packed = _packed(_planes(token.astype("<u4")))
            return record(chunk=[chunk], train_tokens=[int(count_[~held_.to_numpy(zero_copy_only=False)].sum())], ids=one(pa.concat_arrays(ids)),
                          held_out=one(held_), count=one(pa.array(count_)), words=pa.array([_packed_sorted(words)], pa.binary()), n_words=[len(words)], token=pa.array([packed], pa.binary()))

        for part, texts in pieces(batches):
            every, _, count = tokens(texts)
            waiting.append((every, count, part.column("id"), part.column("held_out")))
            size += len(every)
            if size >= CHUNK:
                yield flush()
                chunk += 1
                waiting, size = [], 0
        if waiting:
            yield flush()

    return docs.mapInArrow(run, "chunk long, train_tokens long, ids array<long>, held_out array<boolean>, count array<long>, words binary, n_words long, token binary")


def _unpacked(rows: pa.RecordBatch | pa.Table, i: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, held out, tokens per text, distinct words, place of every token among them, place of the one before it)."""
    ids, held, count = (rows.column(n)[i].values for n in ("ids", "held_out", "count"))
    count = count.to_numpy()
    words = _plain_sorted(rows.column("words")[i].as_py(), rows.column("n_words")[i].as_py())
    token = _from_planes(_plain(rows.column("token")[i].as_py(), 4 * int(count.sum())), "<u4").astype(np.int64)
    # Every text closes with the end, which therefore stands before the next.
    return ids, held.to_numpy(zero_copy_only=False), count, words, token, np.concatenate([np.searchsorted(words, [END]), token[:-1]])


def _joined(rows: pa.Table) -> np.ndarray:
    return np.concatenate([_plain_sorted(k, n) for k, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist())])


def keys_of(chunks_: DataFrame, segments: int, learning: bool) -> DataFrame:
    """(kind, segment, chunk, n, keys, counts): the *n* distinct words or pairs of a chunk that belong to a segment.

    When *learning*, those of its training texts with their counts there; else those of all its texts,
    without counts.  A key is sent once a chunk, however often it occurs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, chunk in enumerate(rows.column("chunk").to_pylist()):
                _, held, count, words, token, before = _unpacked(rows, i)
                if learning and held.all():
                    continue
                pairs, at = np.unique(pair_keys(words[before], words[token]), return_inverse=True)
                for kind, own, place in ((_WORDS, words, token), (_PAIRS, pairs, at)):
                    times = np.zeros(len(own), "<u4")
                    if learning:
                        times = np.bincount(place, np.repeat(~held, count), len(own)).astype("<u4")
                        own, times = own[times > 0], times[times > 0]
                    segment = segments_of(own, segments)
                    low = own >> _SPARE if kind == _PAIRS else own
                    cut = np.flatnonzero(np.diff(segment, prepend=-1))
                    ranges = list(zip(cut.tolist(), [*cut[1:].tolist(), len(own)]))
                    yield record(kind=np.full(len(cut), kind, np.int32), segment=segment[cut], chunk=np.full(len(cut), chunk, np.int64),
                                 n=np.array([b - a for a, b in ranges], np.int64),
                                 keys=pa.array([_packed_sorted(low[a:b]) for a, b in ranges], pa.binary()),
                                 counts=pa.array([_packed(times[a:b]) if learning else None for a, b in ranges], pa.binary()))

    return chunks_.mapInArrow(run, "kind int, segment long, chunk long, n long, keys binary, counts binary")


def segment_rows(learning_keys: DataFrame, bits: int = BITS_PER_ENTRY) -> DataFrame:
    """(kind, segment, n, keys, data): the model's rows from the keys and counts of all chunks.

    Of words the sorted hashes and exact counts are kept, of pairs the filter alone; n is the number of keys entered.
    """
    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        counts = [_plain(c, 4 * n) for c, n in zip(rows.column("counts").to_pylist(), rows.column("n").to_pylist())]
        keys, at = np.unique(_joined(rows), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(counts), "<u4"), len(keys)).astype("<i8")
        words = kind == _WORDS
        return pa.table({"kind": pa.array([kind], pa.int32()), "segment": [rows.column("segment")[0].as_py()], "n": [len(keys)],
                         "keys": pa.array([_packed_sorted(keys) if words else b""], pa.binary()),
                         "data": pa.array([_packed(total) if words else filled_segment(keys, total, bits)], pa.binary())})

    return learning_keys.groupBy("kind", "segment").applyInArrow(run, "kind int, segment long, n long, keys binary, data binary")


@dataclass(frozen=True)
class Model:
    """A learned model: a stored table of segments and the few numbers that every probability takes."""

    rows: DataFrame
    segments: int
    train_tokens: int
    vocabulary: int
    weight: float = WEIGHT


def _learned(stored: DataFrame, weight: float, bits: int) -> Model:
    """The model of the training texts of stored chunks."""
    n = stored.agg(F.sum("train_tokens")).first()[0] or 0
    segments = max(1, -(-n // PER_SEGMENT))
    rows = settle(segment_rows(keys_of(stored, segments, True), bits), "segments")
    return Model(rows, segments, n, rows.where(F.col("kind") == _WORDS).agg(F.sum("n")).first()[0] or 0, weight)


def learn(docs: DataFrame, text: str = "text", weight: float = WEIGHT, bits: int = BITS_PER_ENTRY) -> Model:
    """A model of all texts of *docs*, a null text as an empty one; *bits* of the filter for each step of a pair."""
    named = docs.select(F.lit(0).cast("long").alias("id"), F.lit(False).alias("held_out"), F.col(text).alias("text"))
    return _learned(settle(chunks(named), "chunks"), weight, bits)


def answered(asked: DataFrame, model: Model) -> DataFrame:
    """(kind, segment, chunk, n, found): what the model has for the keys of each row of *asked*, in order.

    Words get exact counts (eight bytes), pairs the number of steps that the filter's segment shows (one byte).
    """
    def run(asked_: pa.Table, stored: pa.Table) -> pa.Table:
        n = asked_.column("n").to_pylist()
        found = np.zeros(sum(n), np.int64)
        if asked_.num_rows and stored.num_rows:
            kind, data = asked_.column("kind")[0].as_py(), stored.column("data")[0].as_py()
            keys = _joined(asked_)
            if kind == _WORDS:
                known = _plain_sorted(stored.column("keys")[0].as_py(), stored.column("n")[0].as_py())
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = np.where(known[at] == keys, np.frombuffer(_plain(data, 8 * len(known)), "<i8")[at], 0)
            else:
                found = probed_segment(data, keys)
        cut = np.cumsum([0, *n]).tolist()
        width = {_WORDS: "<i8", _PAIRS: "u1"}
        kinds = asked_.column("kind").to_pylist()
        return pa.table({"kind": asked_.column("kind"), "segment": asked_.column("segment"), "chunk": asked_.column("chunk"), "n": asked_.column("n"),
                         "found": pa.array([_packed(found[a:b].astype(width[k])) for k, a, b in zip(kinds, cut, cut[1:])], pa.binary())})

    return asked.select("kind", "segment", "chunk", "n", "keys").groupBy("kind", "segment").cogroup(
        model.rows.select("kind", "segment", "n", "keys", "data").groupBy("kind", "segment")).applyInArrow(
        run, "kind int, segment long, chunk long, n long, found binary")


def _scored(stored: DataFrame, model: Model, id_column: str) -> DataFrame:
    n, weight = model.train_tokens, model.weight
    bottom = n + ADD * (model.vocabulary + 1)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by([("kind", "ascending"), ("segment", "ascending")])
        blobs: dict[int, list[bytes]] = {_WORDS: [], _PAIRS: []}
        for kind, size, found in zip(*(answers.column(c).to_pylist() for c in ("kind", "n", "found"))):
            blobs[kind].append(_plain(found, size * (8 if kind == _WORDS else 1)))
        ids, held_out, count, words, token, before = _unpacked(chunk, 0)
        c = np.frombuffer(b"".join(blobs[_WORDS]), "<i8")
        at = np.unique(pair_keys(words[before], words[token]), return_inverse=True)[1]
        pair = np.concatenate([[0], STEPS])[np.frombuffer(b"".join(blobs[_PAIRS]), np.uint8)][at]
        context = c[before]
        # A pair cannot outnumber its context or its word: what is above that is a false hit of the filter.
        share = weight * np.minimum(np.minimum(pair, context), c[token]) / np.maximum(context, 1)
        frequency = ((c + ADD) / bottom)[token]
        owner = np.repeat(np.arange(len(count)), count)
        base, mixed, known = [np.bincount(owner, x, len(count)) for x in (
            np.log10(frequency), np.log10(share + (1 - weight) * frequency), c[token] > 0)]
        return pa.table({id_column: ids, "held_out": held_out, "n_tokens": count, "n_known": known.astype(np.int64),
                         "train_tokens": np.full(len(count), n, np.int64), "base_score": base, "score": mixed})

    answers = answered(keys_of(stored, model.segments, False), model)
    return stored.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, f"`{id_column}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row per row of *docs*, which the model need not have seen.

    A null text is empty and has the end as its only token; a null id stays null.  A model without
    training tokens gives every token the smoothed probability of an unknown word.
    """
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.lit(True).alias("held_out"), F.col(text).alias("text"))
    return _scored(settle(chunks(named), "chunks"), model, id_column).drop("held_out")


def train_and_score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", folds: int = 10,
                    weight: float = WEIGHT, bits: int = BITS_PER_ENTRY) -> DataFrame:
    """Learn from the rows outside the held-out fold, score all rows by the stored model.

    (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of *docs*.  A
    null text is empty and has the end as its only token.  A null id is never held out.  Without
    training tokens every probability is the smoothed one of an unknown word.  No word or context is
    treated by its frequency.
    """
    held = F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == 0, F.lit(False))
    named = docs.select(F.col(id_column).cast("long").alias("id"), held.alias("held_out"), F.col(text).alias("text"))
    stored = settle(chunks(named), "chunks")
    return _scored(stored, _learned(stored, weight, bits), id_column)
