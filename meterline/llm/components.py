"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.session import settle

ROUNDS = 60


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours hung on the least of them: the larger ones, or the smaller ones and itself."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of *links* (u, v) of numbers.

    Alternating large and small stars: every round hangs each neighbourhood on its least node; the
    link count never grows, and the number of rounds grows with the logarithm of the longest path.
    Every round is written to the shared folder, so a lost executor repeats one round at most.
    Null ends and links of a node to itself are ignored; an empty table gives an empty one.
    """
    links = settle(links.select(F.col("u").cast("long"), F.col("v").cast("long"))
                   .where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct(), "links")
    last = None
    for _ in range(ROUNDS):
        links = settle(_stars(_stars(links, True), False), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("the links did not settle into components")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
