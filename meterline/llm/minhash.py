"""Near-duplicate texts by circulant MinHash, with exact Jaccard verification.

Two permutations of the 32-bit numbers make the whole signature: the first scatters a shingle's place,
the second, circularly shifted by k, is read at that place for coordinate k.  Bands of coordinates
are buckets.  Links are confirmed on full shingle sets, in two rounds that never list all pairs of a bucket:

1. every text of a bucket is compared with the bucket's least text, so a group of n copies costs n comparisons;
2. only buckets whose texts are still in different components are looked at again: all their pairs
   across components are compared inside tasks, block by block, and only links that join components leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.components import connected_components
from meterline.llm.tables import pieces, record
from meterline.llm.words import hashed_words, mix, shingles
from meterline.session import settle

BANDS, ROWS = 36, 7
WIDTH = 5
#: Texts of a bucket that one task compares with each other at most (two such blocks).
BLOCK = 256
_SCATTER = np.uint64(0xA0761D6478BD642F)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signature of each set (uint32); that of an empty set is all ones."""
    out = np.full((len(sets), size), 2**32 - 1, np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    group: list[int] = []
    total = 0
    for n, i in enumerate(filled):
        group.append(i)
        total += len(sets[i])
        # Blocks that stay in a core's cache.
        if total < 32768 and n + 1 < len(filled):
            continue
        first = (mix(np.concatenate([sets[j] for j in group]) ^ _SCATTER) >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum([0, *[len(sets[j]) for j in group[:-1]]])
        x, y = np.empty_like(first), np.empty_like(first)
        rows = np.empty((size, len(group)), np.uint32)
        for k in range(size):
            # The second permutation (xor-shifts and odd multipliers are bijections) read k places further on.
            np.add(first, np.uint32(k), out=x)
            np.right_shift(x, 16, out=y)
            x ^= y
            x *= np.uint32(0x85EBCA6B)
            np.right_shift(x, 13, out=y)
            x ^= y
            x *= np.uint32(0xC2B2AE35)
            np.right_shift(x, 16, out=y)
            x ^= y
            np.minimum.reduceat(x, begin, out=rows[k])
        out[group] = rows.T
        group, total = [], 0
    return out


def signed(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, high, low, bands): size and 128-bit fingerprint of the shingle set, hash of each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            sets = shingles(*hashed_words(texts), width)
            sign = signatures(sets, bands * rows).reshape(len(texts), bands, rows).astype(np.uint64)
            hashes = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(texts), 1))
            for k in range(rows):
                hashes = mix(hashes * np.uint64(31) + sign[:, :, k])
            with np.errstate(over="ignore"):
                high = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                low = [int(mix(s ^ _SCATTER).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield record(id=part.column("id"), n_shingles=np.array([len(s) for s in sets], np.int64), high=high, low=low,
                         bands=pa.array(list(hashes.view(np.int64)), pa.list_(pa.int64())))

    return docs.mapInArrow(run, "id long, n_shingles long, high long, low long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, shingles): the full set of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            sets = [s.view(np.int64) for s in shingles(*hashed_words(texts), width)]
            yield record(id=part.column("id"), shingles=pa.array(sets, pa.list_(pa.int64())))

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _close(threshold: int):
    """Whether sets a and b of sizes na and nb are similar enough, in whole numbers."""
    shared = F.size(F.array_intersect("a", "b"))
    return 100 * shared >= threshold * (F.size("a") + F.size("b") - shared)


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _linking_pairs(threshold: int):
    """Links within a block, or between two blocks, that join components."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "half"], ignore_index=True)
        forest, links = _Forest(), []
        ids, comps, halves = rows.id.tolist(), rows.component.tolist(), rows.half.tolist()
        sets = [np.sort(s) for s in rows.shingles]
        both = min(halves) != max(halves)
        for i in range(len(ids)):
            for j in range(i):
                if both and halves[i] == halves[j]:
                    continue
                small, big = sorted((len(sets[i]), len(sets[j])))
                if 100 * small < threshold * big or forest.find(comps[i]) == forest.find(comps[j]):
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= threshold * (small + big - shared):
                    forest.up[forest.find(comps[i])] = forest.find(comps[j])
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    return run


def near_duplicates(docs: DataFrame, threshold: int = 85, id_column: str = "doc_id", text: str = "text",
                    width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of *docs*.

    Texts are linked when 100 * shared shingles >= *threshold* * shingles of either.  Texts with equal
    sets are linked through the least id of the class; classes, not copies, are compared.  A text
    without words, or null, has no shingles and links with nothing.  Rows that repeat an id share its
    component and result.  Rows without an id come back with nulls and kept = true.
    Extra columns of *docs* are not read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    rows_ = settle(signed(named, width, bands, rows), "signed")
    # One class per distinct set; its least id stands for it.
    classes = rows_.where("n_shingles > 0 AND id IS NOT NULL").groupBy("high", "low", "n_shingles").agg(F.min("id").alias("rep"))
    member = rows_.where("n_shingles > 0 AND id IS NOT NULL").join(classes, ["high", "low", "n_shingles"]).select("id", "rep", "bands")
    alike = member.where("id != rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    spread = member.where("id = rep").dropDuplicates(["id"]).select("id", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    crowd = settle(spread.join(buckets.select("bucket", "least"), "bucket"), "buckets")

    # Round 1: every text of a bucket against its least one.
    pairs = crowd.where("id > least").select(F.col("least").alias("u"), F.col("id").alias("v")).distinct()
    wanted = crowd.select("id").distinct()
    sets = settle(shingle_sets(named.where("id IS NOT NULL").join(wanted, "id").dropDuplicates(["id"]), width), "sets")
    a, b = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    linked = settle(pairs.join(b, "v").join(a, "u").where(_close(threshold)).select("u", "v"), "links")

    # Round 2: buckets that hold several components; those with the same texts are looked at once.
    placed = connected_components(linked)
    known = crowd.select("bucket", "id").join(placed.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    mixed = known.groupBy("bucket").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("texts")).where("c0 < c1")
    mixed = mixed.groupBy("n", "texts").agg(F.min("bucket").alias("bucket")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    spot = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    inside = known.join(mixed.select("bucket", "blocks"), "bucket").withColumn("own", spot)
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y"), (k < F.col("own")).cast("int").alias("half")))
    blocked = inside.select("bucket", "id", "component", "own", F.explode(others).alias("p")).select(
        "bucket", "id", "component", F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        F.when(F.col("p.x") == F.col("p.y"), 0).otherwise(F.col("p.half")).alias("half"))
    joining = blocked.join(sets, "id").groupBy("bucket", "x", "y").applyInPandas(_linking_pairs(threshold), "u long, v long")
    everything = linked.union(settle(joining, "links")).union(alike)
    final = connected_components(everything)
    return (rows_.join(final.withColumnRenamed("node", "id"), "id", "left")
            .select(F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))))
