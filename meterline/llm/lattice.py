"""Near-duplicate vectors by lattice hashing.

A table projects unit vectors to eight random directions and decodes the point to the nearest point of
the E8 lattice.  A vector lives in its own cell and also looks into the neighbouring cells (of the 240
that touch it) that its point leans to most.  What meets in a cell is compared by cosine, in double
precision.  Pairs never leave a task: a cell gives each vector a number of links and the least vector it
is connected to.  A pair that meets several times counts where it meets first, by table and cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.components import connected_components
from meterline.llm.tables import record
from meterline.llm.vectors import by_dimension, matrix, unit, usable
from meterline.llm.words import mix
from meterline.session import settle

#: At cosine 0.9 one table meets a pair with probability 0.70, so eight miss 7 in 100,000; closer pairs less.
TABLES, PROBES, SCALE = 8, 8, 0.7
#: Rows of a cell compared with each other in one task, and rows of a group of cells.
BLOCK, GROUP = 2048, 8192


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[i], row[j] = s, t
            whole.append(row)
    half = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the better of the nearest in D8 (whole coordinates, even sum) and in D8 + 1/2."""
    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
        gap = y[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a)**2).sum(1) <= ((x - b)**2).sum(1))[:, None], a, b)


@lru_cache(8)
def _tables(size: int, tables: int, scale: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng([seed, size])
    return [(rng.normal(size=(size, 8)) * scale, rng.random(8)) for _ in range(tables)]


def _names(points: np.ndarray, table: int) -> np.ndarray:
    out = np.full(len(points), table + 1, np.uint64)
    for k in range(8):
        out = mix(out * np.uint64(31) + np.rint(2 * points[:, k]).astype(np.int64).view(np.uint64))
    return out


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(own cell per table, neighbouring cells looked into per table) of unit vectors."""
    own, around = np.empty((len(x), tables), np.uint64), np.empty((len(x), tables, probes), np.uint64)
    for t, (directions, shift) in enumerate(_tables(x.shape[1], tables, scale, seed)):
        # Summed in one order for every row, so that equal vectors get equal cells in any batch.
        point = np.einsum("ij,jk->ik", x, directions) + shift
        cell = decode(point)
        own[:, t] = _names(cell, t)
        lean = np.argsort(-((point - cell) @ neighbours().T), axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            around[:, t, k] = _names(cell + neighbours()[lean[:, k]], t)
    return own, around


def _first_meeting(a: np.ndarray, b: np.ndarray, own: np.ndarray, around: np.ndarray, table: int, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether pairs (a, b), met in *cell* of *table*, meet there first."""
    first = np.ones(len(a), bool)
    for t in range(table + 1):
        same = own[a, t] == own[b, t]
        sees_b = (around[a, t] == own[b, t][:, None]).any(1)
        sees_a = (around[b, t] == own[a, t][:, None]).any(1)
        if t < table:
            first &= ~(same | sees_b | sees_a)
        else:
            # In one table: the common own cell; else the own cell of one that the other looks into, the lesser id's first.
            less, more = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            sees_less = np.where(ids[a] < ids[b], sees_a, sees_b)
            first &= np.where(same, cell == own[a, t], np.where(sees_less, cell == own[less, t], cell == own[more, t]))
    return first


def _compare(least: float, tables: int, probes: int, scale: float, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "x", "y"], ignore_index=True)
        x = unit(np.stack(rows.v.to_list()).astype(float))
        ids, weight, home, side = rows.id.to_numpy(), rows.n.to_numpy(), rows.home.to_numpy(), rows.side.to_numpy()
        cell, table = rows.cell.to_numpy().view(np.uint64), rows.table.to_numpy()
        key = np.stack([rows.cell.to_numpy(), rows.x.to_numpy(), rows.y.to_numpy()], 1)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1), [True]]))
        out: dict[str, list] = {"id": [], "links": [], "least": []}
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
            here = np.flatnonzero(home[low:high]) + low
            if high - low < 2 or not len(here):
                continue
            close = x[here] @ x[low:high].T >= least
            i, j = np.nonzero(close)
            a, b = here[i], j + low
            # Each pair once; between two blocks only pairs across; never a vector with itself.
            keep = (a != b) & (~home[b] | (a < b)) & (ids[a] != ids[b])
            if rows.x.iat[low] != rows.y.iat[low]:
                keep &= side[a] != side[b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            own, around = cells(x[used], tables, probes, scale, seed)
            p, q = place[:len(a)], place[len(a):]
            t = int(table[low])
            chosen = np.concatenate([_first_meeting(p[k:k + 65536], q[k:k + 65536], own, around, t, np.broadcast_to(cell[low], len(p[k:k + 65536])), ids[used])
                                     for k in range(0, len(p), 65536)])
            p, q = p[chosen], q[chosen]
            if not len(p):
                continue
            links = np.bincount(p, weight[used][q], len(used)) + np.bincount(q, weight[used][p], len(used))
            # The least id that each is connected to within the cell.
            root = ids[used].copy()
            while True:
                low_ = np.minimum(root[p], root[q])
                new = root.copy()
                np.minimum.at(new, p, low_)
                np.minimum.at(new, q, low_)
                if (new == root).all():
                    break
                root = new
            linked = links > 0
            out["id"] += ids[used][linked].tolist()
            out["links"] += links[linked].astype(np.int64).tolist()
            out["least"] += root[linked].tolist()
        return pd.DataFrame(out, dtype="int64")
    return run


def _met(rep: DataFrame, least: float, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """(id, links, least): what the classes *rep* (id, n, v) of one dimension meet in each group of cells."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                own, around = cells(unit(matrix(part.column("v"))), tables, probes, scale, seed)
                every = np.concatenate([own[:, :, None], around], 2)
                width = tables * (probes + 1)
                row = pa.array(np.repeat(np.arange(len(own)), width))
                yield record(
                    cell=every.reshape(-1).view(np.int64), table=np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes + 1), len(own)),
                    home=np.tile(np.arange(width) % (probes + 1) == 0, len(own)), id=part.column("id").take(row),
                    n=part.column("n").take(row), v=part.column("v").take(row))

    placed = rep.mapInArrow(places, f"cell long, table int, home boolean, id long, n long, v {rep.schema['v'].dataType.simpleString()}")
    # Sizes first, without the vectors: cells nobody lives in, or with one row, are done; large ones are cut into blocks.
    sizes = settle(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("lived_in"))
                   .where("rows > 1 AND lived_in").select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "cells")
    many = sizes.where("blocks > 1")
    spot = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    dealt = (placed.join(many, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", spot)
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cell", "table", "home", "id", "n", "v", F.least("own", "k").alias("x"), F.greatest("own", "k").alias("y"),
                     (F.col("own") > F.col("k")).alias("side")))
    total = rep.count() * tables * (probes + 1)
    groups = max(1, -(-total // GROUP))
    return settle(dealt.withColumn("group", F.pmod(F.xxhash64("cell", "x", "y"), F.lit(groups))).groupBy("group").applyInPandas(
        _compare(least, tables, probes, scale, seed), "id long, links long, least long"), "met")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, id_column: str = "vec_id", vector: str = "embedding",
                           tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of *vectors*.

    Linked are vectors found with cosine >= *least*.  Equal vectors are one class, which is hashed once
    and counts as many links as it has members.  Vectors that are null, zero, hold null or non-finite
    components link with nothing; vectors of different dimensions are never compared.  Rows that repeat an id are members
    of their own but share n_links (the greatest) and component.  A null id comes back with no links.
    """
    good = usable(vectors, id_column, vector)
    classes = good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    member = settle(good.join(classes, "v"), "vectors")
    rep = member.where("id = rep").dropDuplicates(["id"]).select("id", "n", "v")
    met = None
    for part in by_dimension(rep):
        own = _met(part, least, tables, probes, scale, seed)
        met = own if met is None else met.union(own)
    outside = met.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    edges = met.where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v")).union(
        member.where("id != rep").select(F.col("rep").alias("u"), F.col("id").alias("v")))
    component = connected_components(edges).withColumnRenamed("node", "id")
    links = (member.select("id", "rep", "n").join(outside, "rep", "left")
             .groupBy("id").agg(F.max(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    return (vectors.select(F.col(id_column).cast("long").alias("id")).join(links, "id", "left").join(component, "id", "left")
            .select(F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))))
