"""Duplicates, timestamp order (from `arrival`) and bucket frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import salted_join, seconds_between
from meterline.operators.arrival import timestamp_order, with_stored_order
from meterline.operators.rollup import tick_frequency

__all__ = ["duplicate_records", "duplicate_ticks", "infer_frequency", "time_steps", "timestamp_order", "with_stored_order"]


def _duplicate_totals(groups: DataFrame, by: list[str]) -> DataFrame:
    """Totals from group sizes ``c``."""
    repeated = F.col("c") > 1
    totals = groups.groupBy(*by).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(repeated, F.col("c"))), F.lit(0)).alias("dup_rows"),
        F.coalesce(F.sum(F.when(repeated, F.col("c") - 1)), F.lit(0)).alias("dup_extra"))
    half = F.col("dup_rows") / 2.0
    return totals.select(*by, "total_rows", "dup_rows", half.alias("dup_half"), "dup_extra",
                         (F.try_divide(half, F.col("total_rows").cast("double")) * 100).alias("dup_pct"))


def duplicate_records(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Duplicate totals of a table over *columns* (NULL equals NULL).

    ``dup_rows`` rows in duplicate groups, ``dup_half`` half of them, ``dup_extra``
    rows beyond the first of their group, ``dup_pct`` dup_half as a share of all rows.
    Copies fold together before the shuffle, so a huge group costs no more than a small one.
    """
    by = by or []
    return _duplicate_totals(rows.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("c")), by)


def duplicate_ticks(series: DataFrame, value: str = "mean") -> DataFrame:
    """Duplicate totals per machine where a record is all sensors' values of one tick.

    An absent value equals NULL, so the sparse form of a rollup needs no grid.  Ticks with the same
    two order-free hashes and number of values are one group; every tick of it is then compared, value
    by value, with the group's first one.  Nothing but single cells and counts is shuffled.  Should two
    records that differ share both hashes, the query fails rather than count them as copies.
    """
    by_tick = ["machine", "ts"]
    x = F.col(value) + F.lit(0.0)  # folds -0.0 into 0.0
    cells = series.where(F.col(value).isNotNull()).select(*by_tick, "sensor", x.alias("x"))

    def folded(*parts):
        return F.coalesce(F.bit_xor(F.when(F.col(value).isNotNull(), F.xxhash64(*parts))), F.lit(0).cast("bigint"))

    group = ["machine", "sig", "sig2", "cells"]
    signed = series.groupBy(*by_tick).agg(
        folded("sensor", x).alias("sig"), folded(x, "sensor", F.lit(2)).alias("sig2"), F.count(value).alias("cells"))
    sizes = signed.groupBy(*group).agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("first_ts"))
    copies = salted_join(signed, sizes.where("c > 1").drop("c"), group, "ts").where("ts > first_ts").select(*by_tick, "first_ts", "cells")
    first = cells.select("machine", F.col("ts").alias("first_ts"), "sensor", F.col("x").alias("first_x"))
    equal = (copies.where("cells > 0").join(cells, by_tick).join(first, ["machine", "first_ts", "sensor"], "left")
             .groupBy(*by_tick, "cells").agg(F.count_if(F.col("x") == F.col("first_x")).alias("same")))
    clashes = equal.groupBy("machine").agg(F.count_if(F.col("same") < F.col("cells")).alias("clashes"))
    totals = _duplicate_totals(sizes.select("machine", "c"), ["machine"])
    checked = totals.join(clashes, "machine", "left")
    rows = F.when(F.col("clashes") > 0, F.raise_error(F.lit("records that differ share both hashes"))).otherwise(F.col("dup_rows"))
    return checked.withColumn("dup_rows", rows.cast("bigint")).select(*totals.columns)


def time_steps(tick_rows: DataFrame) -> DataFrame:
    """(machine, ts, step_s): seconds since the machine's previous tick; first tick left out."""
    order = Window.partitionBy("machine").orderBy("ts")
    return (tick_rows.select("machine", "ts", seconds_between(F.lag("ts").over(order), "ts").alias("step_s"))
            .where(F.col("step_s").isNotNull()))


def infer_frequency(tick_rows: DataFrame, orig_freq_s: int = 10) -> DataFrame:
    """(machine, freq_s, agg_freq, status): bucket length and expected readings per bucket."""
    return (tick_frequency(tick_rows, orig_freq_s).drop("rows")
            .withColumn("status", F.when(F.col("freq_s").isNull(), "not_assessable").otherwise("ok")))
