"""Strongly correlated pairs without forming every pair.

Sensors with the same ticks are unit vectors u over these ticks, and r is their product.  With P the projection on
the leading Fourier coefficients, |r - <Pu, Pv>| <= |u - Pu| |v - Pv|, so a few numbers a sensor tell which pairs can be
strong.  Pairs meet through a grid: |r| > t means that u and v, or u and -v, are nearer than sqrt(2 - 2t), hence so
are their coefficients, and only neighbouring cells are looked up.  What passes is verified on all ticks.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import salted_join
from meterline.operators.correlation import _tick_rows, correlate_blocks, strong_pairs
from meterline.schema import duration_seconds
from meterline.session import settle

_GROUP = ["machine", "group"]
#: Keeps rounding in the bounds from losing a pair at the threshold.
_SLACK = 1e-6


def find_strong_pairs(series: DataFrame, threshold: float = 0.7, value: str = "mean", bucket: str = "1 hour",
                      slice_ticks: int = 2160, block_sensors: int = 256, least_group: int | None = None,
                      frequencies: int = 8) -> DataFrame:
    """(machine, sensor_a, sensor_b, r, n_pairs): the rows of ``strong_pairs(correlation(series), threshold)``.

    Sensors of a machine with the same ticks are a group.  Inside a group of at least *least_group* sensors
    (a block, unless told otherwise) only pairs that may be strong are formed; all other pairs go through the blocked
    product.  How many pairs the bounds spare depends on how much of the series' energy lies in the first *frequencies*
    of the group's ticks.  Starts Spark jobs when called.
    """
    slice_s = duration_seconds(bucket) * slice_ticks
    least = block_sensors if least_group is None else least_group
    rows = _tick_rows(series, value)
    tick_set = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("tick")).alias("h"),
                        F.bit_xor(F.xxhash64("tick", F.lit(1))).alias("k"))
    sensors = rows.groupBy("machine", "sensor").agg(
        tick_set.alias("group"), F.avg("x").alias("centre"), F.var_pop("x").alias("spread"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    size = F.count(F.lit(1)).over(Window.partitionBy("machine", "group"))
    sensors = settle(sensors.withColumn("large", size >= least).withColumn("size", size), "sensors")
    rest = strong_pairs(correlate_blocks(rows, _blocks(sensors, block_sensors), slice_s), threshold)

    # A constant sensor has no correlation with any other.
    varied = sensors.where("large AND lo < hi AND spread > 0").select(
        "machine", "sensor", "group", "centre", F.sqrt(F.col("spread") * F.col("group.n")).alias("length"))
    units = salted_join(rows, varied, ["machine", "sensor"], "tick").select(
        "machine", "sensor", "group", "tick", ((F.col("x") - F.col("centre")) / F.col("length")).alias("u"))
    wanted = settle(candidates(sketches(units, frequencies), threshold), "candidates")
    return rest.unionByName(strong_pairs(verified(units, wanted, slice_s), threshold))


def _blocks(sensors: DataFrame, block_sensors: int) -> DataFrame:
    """Blocks in which a large group has its own, and no block of a large group meets another of the same one."""
    shared = F.ceil(F.count_if(~F.col("large")).over(Window.partitionBy("machine")) / F.lit(block_sensors)).cast("int")
    own = F.ceil(F.col("size") / F.lit(block_sensors)).cast("int")
    groups = sensors.where("large").select(*_GROUP, own.alias("own")).distinct()
    before = F.sum("own").over(Window.partitionBy("machine").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select(*_GROUP, "own", F.coalesce(before, F.lit(0)).cast("int").alias("start"))
    totals = starts.groupBy("machine").agg(F.sum("own").cast("int").alias("owned"))
    laid = (sensors.withColumn("shared", shared).join(starts, _GROUP, "left").join(totals, "machine", "left")
            .withColumn("owned", F.coalesce("owned", F.lit(0))))
    hashed = F.xxhash64("sensor")
    first = F.col("shared") + F.col("start")
    block = F.when(F.col("large"), first + F.pmod(hashed, F.greatest("own", F.lit(1)))).otherwise(
        F.pmod(hashed, F.greatest("shared", F.lit(1)))).cast("int")
    total = F.col("shared") + F.col("owned")
    every = F.sequence(F.lit(0), total - 1)
    others = F.filter(every, lambda b: (b < F.col("first")) | (b >= F.col("first") + F.col("own")))
    return (laid.withColumn("first", first).select(
        "machine", "sensor", "centre", block.alias("block"), F.when(F.col("large"), others).otherwise(every).alias("partners")))


def sketches(units: DataFrame, frequencies: int) -> DataFrame:
    """(machine, group, sensor, c, left): leading Fourier coefficients over the group's ticks, and the length of what they leave."""
    ticks = units.select(*_GROUP, "tick").distinct()
    place = F.row_number().over(Window.partitionBy(*_GROUP).orderBy("tick"))
    ticks = ticks.withColumn("place", place)
    n = F.col("group.n")
    turns = salted_join(units, ticks, [*_GROUP, "tick"], "sensor").withColumn("angle", F.col("place") * (2 * math.pi) / n)
    terms = []
    for k in range(1, frequencies + 1):
        # Beyond half the ticks the waves repeat, and at exactly half they are of another length.
        scale = F.when(2 * k < n, F.sqrt(2.0 / n)).otherwise(0.0)
        terms += [F.sum(F.col("u") * wave(F.col("angle") * k) * scale) for wave in (F.cos, F.sin)]
    found = turns.groupBy(*_GROUP, "sensor").agg(F.array(*terms).alias("c"))
    energy = F.aggregate("c", F.lit(0.0), lambda total, x: total + x * x)
    return found.withColumn("left", F.sqrt(F.greatest(1 - energy, F.lit(0.0))))


def candidates(sketched: DataFrame, threshold: float, axes: int = 3) -> DataFrame:
    """(machine, group, a, b), a before b: pairs whose coefficients do not rule out \\|r\\| > *threshold*."""
    width = math.sqrt(max(2 - 2 * threshold, 0.0)) + _SLACK
    cell = lambda sign: [F.floor(sign * F.col("c")[i] / width).cast("int") for i in range(axes)]
    owned = sketched.select(*_GROUP, F.col("sensor").alias("b"), F.col("c").alias("d"), F.col("left").alias("left_b"), F.array(*cell(1)).alias("cell"))
    near = F.array(*[F.array(*[F.lit(s) for s in step]) for step in product((-1, 0, 1), repeat=axes)])
    asked = sketched.select(*_GROUP, F.col("sensor").alias("a"), "c", F.col("left").alias("left_a"),
                            F.explode(F.array(F.array(*cell(1)), F.array(*cell(-1)))).alias("at"))
    asked = asked.withColumn("step", F.explode(near)).withColumn("cell", F.zip_with("at", "step", lambda p, q: p + q)).drop("at", "step").distinct()
    shared = F.aggregate(F.zip_with("c", "d", lambda p, q: p * q), F.lit(0.0), lambda total, x: total + x)
    return (asked.join(owned, [*_GROUP, "cell"]).where("a < b")
            .where(F.abs(shared) + F.col("left_a") * F.col("left_b") > threshold - _SLACK)
            .select(*_GROUP, "a", "b").distinct())


def verified(units: DataFrame, wanted: DataFrame, slice_s: int) -> DataFrame:
    """(machine, sensor_a, sensor_b, r, n_pairs) of the pairs *wanted*, over all ticks, a slice of time at a time."""
    asked = wanted.select("machine", F.col("a").alias("sensor")).union(wanted.select("machine", F.col("b").alias("sensor"))).distinct()
    vectors = (salted_join(units, asked, ["machine", "sensor"], "tick")
               .groupBy("machine", "sensor", F.expr(f"tick div {slice_s}").alias("slice"))
               .agg(F.array_sort(F.collect_list(F.struct("tick", "u"))).getField("u").alias("v")))
    first = vectors.select("machine", F.col("sensor").alias("a"), "slice", "v")
    second = vectors.select("machine", F.col("sensor").alias("b"), "slice", F.col("v").alias("w"))
    part = F.aggregate(F.zip_with("v", "w", lambda p, q: p * q), F.lit(0.0), lambda total, x: total + x)
    sums = (wanted.join(first, ["machine", "a"]).join(second, ["machine", "b", "slice"])
            .groupBy("machine", "group", "a", "b").agg(F.sum(part).alias("r")))
    return sums.select("machine", F.col("a").alias("sensor_a"), F.col("b").alias("sensor_b"),
                       F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r")).alias("r"), F.col("group.n").alias("n_pairs"))
