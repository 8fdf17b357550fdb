"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is filed in the leaf its nearest centres lead to.
A query walks the tree with a priority queue, always opening the nearest unopened node, and visits
leaves until enough have been seen.  How many are enough is calibrated: for a bounded sample of the
queries the true neighbours are found among all vectors, and visits widen until they hold the wanted recall.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.tables import record
from meterline.llm.vectors import by_dimension, matrix, unit, usable
from meterline.session import settle

#: Vectors the tree is fitted on, children of a node, sample vectors a leaf is made of at least.
SAMPLE, BRANCHES, LEAF = 20_000, 8, 128
#: Queries whose true neighbours calibrate the visits, and the recall wanted of them.
CALIBRATION, RECALL = 256, 0.97
#: Rows of a leaf that one task compares with a block of queries, and queries in that block.
ROWS, QUERIES = 4096, 4096


@dataclass
class Tree:
    """Nodes by number; a leaf has no children."""
    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node] or not len(rows):
                at[rows] = node
                continue
            nearest = np.einsum("ij,kj->ik", x[rows], np.stack([self.centres[c] for c in self.children[node]])).argmax(1)
            todo += [(c, rows[nearest == k]) for k, c in enumerate(self.children[node])]
        return at

    def visits(self, q: np.ndarray, most: int | None = None) -> list[int]:
        """Leaves in the order of the search, best bin first."""
        queue, found = [(0.0, 0)], []
        near = self._all @ q
        while queue and (most is None or len(found) < most):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(node)
            for c in self.children[node]:
                heapq.heappush(queue, (-float(near[c]), c))
        return found

    def finish(self) -> Tree:
        self._all = np.stack(self.centres)
        return self


def fit(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, rounds: int = 8, seed: int = 11) -> Tree:
    """Hierarchical k-means on unit vectors: a node with fewer than branches * leaf of them is not split."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(rows: np.ndarray, centre: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(centre)
        tree.children.append([])
        if len(rows) < branches * leaf:
            return node
        centres = x[rng.choice(rows, branches, replace=False)]
        for _ in range(rounds):
            own = (x[rows] @ centres.T).argmax(1)
            sums = np.stack([x[rows[own == k]].sum(0) for k in range(branches)])
            size = np.sqrt((sums * sums).sum(1, keepdims=True))
            centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
        own = (x[rows] @ centres.T).argmax(1)
        parts = [rows[own == k] for k in range(branches)]
        if max(map(len, parts)) == len(rows):
            return node
        tree.children[node] = [grow(part, c) for part, c in zip(parts, centres)]
        return node

    grow(np.arange(len(x)), x.mean(0) if len(x) else np.zeros(x.shape[1] if x.ndim == 2 else 0))
    return tree.finish()


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each sum in the same order: equal vectors get equal numbers."""
    norm = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return (a * b).sum(1) / norm


def _nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k nearest of *x* to each query, its own row left out; ties go to the smaller id."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    near = unit(q) @ unit(x).T
    near[query_ids[:, None] == ids[None, :]] = -np.inf
    for i in range(len(q)):
        row = near[i]
        # The product's last bits hang on its blocks, so all that might be among the k are measured again.
        least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2.0
        maybe = np.flatnonzero(row >= max(least - 1e-9, -2.0))
        score = cosines(np.broadcast_to(q[i], (len(maybe), q.shape[1])), x[maybe])
        best = np.lexsort((ids[maybe], -score))[:k]
        out["query_id"] += [query_ids[i]] * len(best)
        out["vec_id"] += ids[maybe[best]].tolist()
        out["score"] += score[best].tolist()
    return {n: np.array(v, float if n == "score" else np.int64) for n, v in out.items()}


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated_visits(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, sample: int = CALIBRATION, recall: float = RECALL) -> int:
    """Leaves to visit, so that a sample of *queries* (id, v) would have found *recall* of its true neighbours among all *rows*."""
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(chosen):
        return 1
    q, names = np.stack(chosen.v.to_list()).astype(float), chosen.id.to_numpy()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, ids = matrix(part.column("v")), part.column("id").to_numpy()
                got = _nearest(names, q, ids, x, k)
                leaf = dict(zip(ids.tolist(), tree.leaves(unit(x)).tolist()))
                yield record(**got, leaf=np.array([leaf[i] for i in got["vec_id"].tolist()], np.int64))

    truth = _best(rows.mapInArrow(exact, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").toPandas()
    if not len(truth):
        return 1
    order = {n: {leaf: i for i, leaf in enumerate(tree.visits(v))} for n, v in zip(names.tolist(), unit(q))}
    needed = np.sort([order[n][leaf] + 1 for n, leaf in zip(truth.query_id.tolist(), truth.leaf.tolist())])
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)])


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", vector: str = "embedding",
                       sample: int = SAMPLE, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the *k* nearest found of each row whose id is divisible by *every*.

    Candidates are all rows but the query's own.  Vectors that are null, zero, hold null or non-finite
    components take no part, nor do rows without an id; each dimension has a tree of its own, and candidates are of
    the query's dimension.  Rows that repeat an id are one candidate, the nearest of them.  With fewer than *k*
    candidates all are returned.
    """
    parts = by_dimension(settle(usable(vectors, id_column, vector), "rows"))
    found = None
    for rows in parts:
        own = _found(rows, every, k, sample, recall, leaf)
        found = own if found is None else found.union(own)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(rows: DataFrame, every: int, k: int, sample: int, recall: float, leaf: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each query in each bin it asks, for vectors of one dimension."""
    kind = rows.schema["v"].dataType.simpleString()
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    tree = fit(unit(np.stack(fitted.v.to_list()).astype(float)) if len(fitted) else np.zeros((0, 1)), leaf=leaf)
    queries = rows.where(F.col("id") % every == 0)
    visits = calibrated_visits(rows, queries, tree, k, recall=recall)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(leaf=tree.leaves(unit(matrix(batch.column("v")))), id=batch.column("id"), v=batch.column("v"))

    filed = settle(rows.mapInArrow(file, f"leaf long, id long, v {kind}"), "filed")
    # One count a leaf, of which there are at most sample / leaf * branches.
    blocks = {r.leaf: -(-r["count"] // ROWS) for r in filed.groupBy("leaf").count().collect()}
    parts = max(1, -(-queries.count() // QUERIES))
    spread = max(1, max(blocks.values(), default=1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column("v")), batch.column("id").to_pylist()
            for i, q in enumerate(unit(x)):
                at = [(leaf * spread + b) * parts + ids[i] // every % parts for leaf in tree.visits(q, visits) for b in range(blocks.get(leaf, 0))]
                same = pa.array(np.full(len(at), i))
                yield record(bin=np.array(at, np.int64), id=batch.column("id").take(same), v=batch.column("v").take(same))

    asked = queries.mapInArrow(ask, f"bin long, id long, v {kind}")
    size = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    kept = filed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.coalesce(F.try_element_at(size, F.col("leaf").cast("int")), F.lit(1)))).select(
        "id", "v", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: (F.col("leaf") * spread + F.col("block")) * parts + p)).alias("bin"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame(_nearest(left.id.to_numpy(), np.stack(left.v.to_list()).astype(float), right.id.to_numpy(),
                                     np.stack(right.v.to_list()).astype(float), k))

    return asked.groupBy("bin").cogroup(kept.groupBy("bin")).applyInPandas(compare, "query_id long, vec_id long, score double")
