"""Text quality: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; a learned table gives each bin a value, each selected pair of
features a small grid of values, and the score is the logistic of their sum.  The tables are learned by
boosting shallow trees in cycles, one feature (later: one pair) at a time, on a bounded sample of
labelled rows; every text is scored by adding looked-up bins, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.tables import pieces, record

FEATURES = [
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "beyond_ascii", "exclamation", "bar", "symbol",
    "full_stop", "comma", "repeated_mark", "log_words", "word_length", "distinct_words", "distinct_lines",
    "short_words", "line_words", "upper_of_letters",
]
#: Labelled rows learned from at most; the bound on what reaches the driver.
SAMPLE = 20_000

_LOOK = np.zeros(256, bool)
_LOOK[[*b"#$%&*@~^=+<>\\_{}[]"]] = True


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        if not text:
            continue
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        n, counts = len(data), np.bincount(data, minlength=256)
        words, lines = text.split(), text.splitlines()
        upper, lower = counts[65:91].sum(), counts[97:123].sum()
        marks = ((data[1:] == data[:-1]) & (data[1:] > 32) & (data[1:] < 65) & ((data[1:] < 48) | (data[1:] > 57))).sum()
        m = max(1, len(words))
        out[i] = (
            np.log1p(n), upper / n, lower / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n,
            counts[128:].sum() / n, counts[33] / n, counts[124] / n, counts[_LOOK].sum() / n, counts[46] / n,
            counts[44] / n, marks / n, np.log1p(len(words)), sum(map(len, words)) / m, len(set(words)) / m,
            len(set(lines)) / max(1, len(lines)), sum(len(w) < 4 for w in words) / m, len(words) / max(1, len(lines)),
            upper / max(1, upper + lower))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AdditiveModel:
    """Bin edges and values per feature, coarse edges and grids per pair."""
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), grid in self.pairs.items():
            total += grid[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return _sigmoid(total)


def _shallow_tree(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """Values per bin of a tree with *splits* splits, from the bins' gradients and curvatures."""
    value = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(splits):
        best = (1e-9, None, 0)
        for low, high in parts:
            if high - low < 2:
                continue
            left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
            all_g, all_h = g[low:high].sum(), h[low:high].sum()
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g)**2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (low, high), low + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for low, high in parts:
        value[low:high] = g[low:high].sum() / (h[low:high].sum() + ridge)
    return value


def _cross_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, grid) of the best cut into four quadrants."""
    corner_g, corner_h = g.cumsum(0).cumsum(1)[:-1, :-1], h.cumsum(0).cumsum(1)[:-1, :-1]
    if not corner_g.size:
        return 0.0, np.zeros_like(g)
    rows_g, rows_h = g.sum(1).cumsum()[:-1, None], h.sum(1).cumsum()[:-1, None]
    cols_g, cols_h = g.sum(0).cumsum()[None, :-1], h.sum(0).cumsum()[None, :-1]
    parts = [(corner_g, corner_h), (rows_g - corner_g, rows_h - corner_h), (cols_g - corner_g, cols_h - corner_h),
             (g.sum() - rows_g - cols_g + corner_g, h.sum() - rows_h - cols_h + corner_h)]
    gain = sum(a**2 / (b + ridge) for a, b in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    grid = np.empty_like(g)
    for (a, b), place in zip(parts, ((np.s_[:i + 1], np.s_[:j + 1]), (np.s_[:i + 1], np.s_[j + 1:]),
                                     (np.s_[i + 1:], np.s_[:j + 1]), (np.s_[i + 1:], np.s_[j + 1:]))):
        grid[place] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j] - g.sum()**2 / (h.sum() + ridge)), grid


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, cells: int = 8, cycles: int = 120, pair_cycles: int = 40,
        n_pairs: int = 6, rate: float = 0.15, ridge: float = 3.0) -> AdditiveModel:
    """Cyclic boosting of one-feature trees, then of four-quadrant trees on the pairs that still explain most."""
    n_features = x.shape[1]

    def cut(values: np.ndarray, parts: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.linspace(0, 1, parts + 1)[1:-1])) if len(values) else np.zeros(0)

    edges = [cut(x[:, j], bins) for j in range(n_features)]
    coarse = [cut(x[:, j], cells) for j in range(n_features)]
    # Smoothed, so that an empty sample or one of a single class still gives a finite base.
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], coarse, float(np.log(share / (1 - share))))
    if not len(y):
        return model
    place = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    total = np.full(len(y), model.base)
    for _ in range(cycles):
        for j in range(n_features):
            p = _sigmoid(total)
            size = len(edges[j]) + 1
            step = rate * _shallow_tree(np.bincount(place[j], y - p, size), np.bincount(place[j], p * (1 - p), size), 2, ridge)
            model.tables[j] += step
            total += step[place[j]]
    wide = [len(e) + 1 for e in coarse]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def sums(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, shape = small[a] * wide[b] + small[b], (wide[a], wide[b])
        return (np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape),
                np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape))

    p = _sigmoid(total)
    gains = sorted(((-_cross_tree(*sums(a, b, p), ridge)[0], a, b) for a in range(n_features) for b in range(a)))
    for _, a, b in gains[:n_pairs]:
        model.pairs[a, b] = np.zeros((wide[a], wide[b]))
    for _ in range(pair_cycles):
        for (a, b), grid in model.pairs.items():
            step = rate * _cross_tree(*sums(a, b, _sigmoid(total)), ridge)[1]
            grid += step
            total += step[small[a], small[b]]
    return model


def held_out(id_column: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(id_column).cast("string")) % folds == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_column: str = "doc_id",
          text: str = "text", folds: int = 5) -> AdditiveModel:
    """Fit on at most *sample* labelled documents outside the held-out fold.

    The sample is the rows whose ids hash lowest, so it is the same on every run.  Rows without a
    label of 0 or 1 are ignored; a document with several labels counts with the lowest one, a repeated
    document once.  Without labels the model gives 0.5 to everything.
    """
    marked = (labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
              .where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id", folds))
              .groupBy("id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    # At most *sample* ids and labels: a bounded broadcast.
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(marked), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield record(id=part.column("id"), y=part.column("y"), x=pa.array(list(features(texts)), pa.list_(pa.float64())))

    # One row an id before anything is sent to the driver.
    found = (rows.mapInArrow(run, "id long, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
             .orderBy("id").toPandas())
    x = np.stack(found.x.to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(x, found.y.to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_column: str = "doc_id", text: str = "text",
          folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) of every row; a null text is an empty one, a null id is never held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            yield record(id=rows.column("id"), held_out=rows.column("held_out"), score=model.score(features(texts)))

    found = (docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(held_out(id_column, folds), F.lit(False)).alias("held_out"),
                         F.col(text).alias("text")).mapInArrow(run, "id long, held_out boolean, score double"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of *docs*, all columns as they are, whose text scores at least *threshold*."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, text):
            yield rows.filter(pa.array(model.score(features(texts)) >= threshold))

    return docs.mapInArrow(run, schema)
