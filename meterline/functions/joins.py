"""Join helpers for hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measure_hot(rows: DataFrame, keys: list[str], parts: int | None = None) -> dict[int, int]:
    """Salts by hash of key, for the keys with more than one *parts*-th of the rows; starts a job.

    A frequent-items sketch over the key columns only, merged on the cluster: at most *parts* items (the shuffle
    partitions, unless told otherwise) reach the driver.  A key gets as many salts as it fills such parts.
    The sketch counts a key at most 3.5 / 8 of a part too high, which costs a salt more, never a row.
    """
    parts = int(parts or rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = F.expr(f"approx_top_k(_h, {parts}, {8 * parts})")
    found = rows.select(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    return {top["item"]: min(parts, math.ceil(top["count"] * parts / found.n))
            for top in (found.top or []) if top["count"] * parts > found.n}


def salted_join(rows: DataFrame, stats: DataFrame, keys: list[str], spread_by: str,
                salts: int = 8, how: str = "inner", hot: dict[int, int] | None = None, from_files: bool = False) -> DataFrame:
    """Join many *rows* to one *stats* row per key without a hot partition.

    Rows of a key scatter over *salts* partitions by a hash of *spread_by*; the
    stats row is repeated once per salt.  With *hot* (``measure_hot`` of the rows) only the keys named there are
    spread, each by its share, and all other stats rows stay single.  When Catalyst finds the stats small
    enough it broadcasts them and the salt is only one more equality.

    Catalyst takes stats read *from_files* for as small as their compressed columns, and repeated rows for one.
    Joining them to the list of salts makes it count every copy, so that none but small stats are broadcast.
    """
    if hot is not None and not hot:
        return rows.join(stats, keys, how)
    if hot is not None and any(rows.schema[k].dataType != stats.schema[k].dataType for k in keys):
        raise ValueError("measured salts need keys of one type on both sides: their hashes must agree")
    count = F.lit(salts) if hot is None else _salts_of(hot, keys)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), count).cast("int"))
    salted_stats = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    if from_files and hot is None:
        copies = rows.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))
        salted_stats = salted_stats.join(F.broadcast(copies), "_salt")
    return salted_rows.join(salted_stats, [*keys, "_salt"], how).drop("_salt")


def _salts_of(hot: dict[int, int], keys: list[str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.xxhash64(*keys)), F.lit(1))
