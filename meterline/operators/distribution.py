"""Histogram, density and box-plot numbers per sensor."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import salted_join
from meterline.operators.outliers import iqr_fences, outside_fences
from meterline.operators.quantiles import exact_quantiles

KEYS = ["machine", "sensor"]


def bin_layout(series: DataFrame, value: str = "mean", method: str = "percentile") -> DataFrame:
    """(machine, sensor, n, low, high, n_bins, bin_width) with automatic bins.

    The bin width is the narrower of the Sturges and Freedman-Diaconis widths
    (Sturges alone when the quartiles coincide); one unit-wide bin for a constant.
    """
    q = F.col("quantiles")
    stats = series.where(F.col(value).isNotNull()).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("x0"), F.max(value).alias("x1"))
    quartiles = exact_quantiles(series, KEYS, value, [0.25, 0.75], method)
    extent = F.col("x1") - F.col("x0")
    sturges = extent / (F.log2("n") + 1)
    fd = (q[1] - q[0]) * 2 / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    constant = extent == 0
    n_bins = F.when(constant, F.lit(1).cast("bigint")).otherwise(F.ceil(F.try_divide(extent, width)))
    laid = stats.join(quartiles, KEYS).select(
        *KEYS, "n", F.when(constant, F.col("x0") - 0.5).otherwise(F.col("x0")).alias("low"),
        F.when(constant, F.col("x1") + 0.5).otherwise(F.col("x1")).alias("high"), n_bins.alias("n_bins"))
    return laid.withColumn("bin_width", (F.col("high") - F.col("low")) / F.col("n_bins"))


def histogram(series: DataFrame, value: str = "mean", method: str = "percentile", dense: bool = False) -> DataFrame:
    """(machine, sensor, n_bins, bin, bin_low, bin_high, count); the last bin is closed.

    Bins without a value are left out unless ``dense``: a far outlier can make millions of them.
    """
    layout = bin_layout(series, value, method)
    placed = salted_join(series.where(F.col(value).isNotNull()).select(*KEYS, "ts", F.col(value).alias("x")),
                         layout, KEYS, "ts")

    def edge(k):
        return F.col("low") + k * F.col("bin_width")

    guess = F.least(F.floor((F.col("x") - F.col("low")) / F.col("bin_width")), F.col("n_bins") - 1)
    placed = placed.withColumn("guess", guess)
    g = F.col("guess")
    # Rounding may put a value one bin beside the edges reported below.
    settled = (F.when((F.col("x") < edge(g)) & (g > 0), g - 1)
               .when((F.col("x") >= edge(g + 1)) & (g < F.col("n_bins") - 1), g + 1).otherwise(g))
    counts = (placed.withColumn("bin", settled).groupBy(*KEYS, "n_bins", "low", "bin_width", "bin")
              .agg(F.count(F.lit(1)).alias("count")))
    if dense:
        bins = _listed_bins(layout)
        counts = (bins.join(counts.select(*KEYS, "bin", "count"), [*KEYS, "bin"], "left")
                  .withColumn("count", F.coalesce("count", F.lit(0).cast("bigint"))))
    return counts.select(*KEYS, "n_bins", "bin", edge(F.col("bin")).alias("bin_low"),
                         edge(F.col("bin") + 1).alias("bin_high"), "count")


def _listed_bins(layout: DataFrame) -> DataFrame:
    """A row per bin, first the starts of runs and then the bins of each: no row holds more than the root of their number."""
    run = F.ceil(F.sqrt("n_bins")).cast("bigint")
    runs = layout.select(*KEYS, "n_bins", "low", "bin_width", run.alias("run")).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1, F.col("run"))))
    return runs.select(*KEYS, "n_bins", "low", "bin_width",
                       F.explode(F.sequence("first", F.least(F.col("first") + F.col("run"), F.col("n_bins")) - 1)).alias("bin"))


#: Power sums kept of a bin.
_ORDERS = 9


def density(series: DataFrame, value: str = "mean", points: int = 200, method: str = "values") -> DataFrame:
    """(machine, sensor, point, x, density): Gaussian kernel estimate, Scott bandwidth.

    *points* evenly spaced places from the smallest to the largest value.  A task sums the kernels of its
    rows of a sensor at all places at once, and only these sums, *points* a sensor and batch, leave it.
    ``"values"`` folds equal values into one weighted row first.  ``"moments"`` folds values into bins a quarter of a
    bandwidth wide and keeps nine power sums of each, so the cost does not depend on how many values differ; each
    kernel is then off by less than 2e-11 of its height.  A sensor without spread gets NULL densities.
    """
    if method not in ("values", "moments"):
        raise ValueError(f"unknown method {method!r}")
    values = series.where(F.col(value).isNotNull()).select(*KEYS, F.col(value).cast("double").alias("v"))
    stats = values.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("x0"), F.max("v").alias("x1"),
        F.stddev_samp("v").alias("std"))
    bandwidth = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = stats.select(*KEYS, "n", "x0", "x1", F.nullif(bandwidth, F.lit(0.0)).alias("bw"))
    place = F.col("x0") + F.col("point") * ((F.col("x1") - F.col("x0")) / (points - 1))
    if method == "values":
        weighted = values.groupBy(*KEYS, "v").agg(F.count(F.lit(1)).alias("w"))
        joined = salted_join(weighted, stats, KEYS, "v").select(*KEYS, "v", "w", "n", "x0", "x1", "bw").where("bw IS NOT NULL")
        summed = _kernel_sums(points)
    else:
        joined = _binned_moments(salted_join(values, stats.where("bw IS NOT NULL"), KEYS, "v"))
        summed = _series_sums(points)
    sums = (joined.sortWithinPartitions(*KEYS)
            .mapInPandas(summed, "machine string, sensor string, point int, k double")
            .groupBy(*KEYS, "point").agg(F.sum("k").alias("k")))
    places = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", place)
    return (places.join(sums, [*KEYS, "point"], "left")
            .select(*KEYS, "point", "x",
                    (F.col("k") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density")))


def _binned_moments(values: DataFrame) -> DataFrame:
    """Power sums m0, m1, ... of the distances to the bin's centre, in bandwidths, per sensor and bin of a quarter bandwidth.

    With |e| <= 1/8 the terms e^k He_k(z) exp(-z^2/2) / k! of a kernel are at most 1.09 e^k / sqrt(k!), so those from
    k = 9 on are below 2e-11 together.
    """
    width = F.col("bw") / 4
    bin_ = F.floor((F.col("v") - F.col("x0")) / width)
    centre = F.col("x0") + (F.col("bin") + 0.5) * width
    off = (values.withColumn("bin", bin_).withColumn("centre", centre)
           .withColumn("e", (F.col("v") - F.col("centre")) / F.col("bw")).drop("v").withColumnRenamed("centre", "v"))
    return off.groupBy(*KEYS, "x0", "x1", "bw", "bin", "v").agg(
        *[F.sum(F.pow("e", F.lit(float(k)))).alias(f"m{k}") for k in range(_ORDERS)])


def _series_sums(points: int, rows: int = 1024):
    """Kernel sums at all places from the power sums of bins: Hermite series around each bin's centre."""
    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for (machine, sensor, x0, x1, bw), own in frame.groupby([*KEYS, "x0", "x1", "bw"], sort=False):
                x = x0 + np.arange(points) * ((x1 - x0) / (points - 1))
                k, v = np.zeros(points), own["v"].to_numpy()
                moments = own[[f"m{i}" for i in range(_ORDERS)]].to_numpy()
                for i in range(0, len(v), rows):
                    z = (x[None, :] - v[i:i + rows, None]) / bw
                    before, here, factor = np.zeros_like(z), np.ones_like(z), 1.0
                    total = moments[i:i + rows, 0, None] * here
                    for order in range(1, _ORDERS):
                        before, here = here, z * here - (order - 1) * before
                        factor *= order
                        total += moments[i:i + rows, order, None] / factor * here
                    k += (total * np.exp(-0.5 * z * z)).sum(axis=0)
                yield pd.DataFrame({"machine": machine, "sensor": sensor, "point": np.arange(points, dtype="int32"), "k": k})
    return run


def _kernel_sums(points: int, rows: int = 1024):
    """Weighted kernel sums at all places, per sensor of a batch; *rows* bounds the matrix in memory."""
    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for (machine, sensor, x0, x1, bw), own in frame.groupby([*KEYS, "x0", "x1", "bw"], sort=False):
                x = x0 + np.arange(points) * ((x1 - x0) / (points - 1))
                k, v, w = np.zeros(points), own["v"].to_numpy(), own["w"].to_numpy()
                for i in range(0, len(v), rows):
                    k += w[i:i + rows] @ np.exp(-0.5 * ((x[None, :] - v[i:i + rows, None]) / bw) ** 2)
                yield pd.DataFrame({"machine": machine, "sensor": sensor, "point": np.arange(points, dtype="int32"), "k": k})
    return run


def _fenced(series: DataFrame, value: str, method: str) -> DataFrame:
    rows = series.where(F.col(value).isNotNull()).select(*KEYS, "ts", F.col(value).alias("value"))
    return salted_join(rows, iqr_fences(rows, "value", method), KEYS, "ts")


def box_stats(series: DataFrame, value: str = "mean", method: str = "percentile") -> DataFrame:
    """(machine, sensor, q1, median, q3, low_whisker, high_whisker, fliers): whiskers are the
    furthest values within the fences, fliers the number of values beyond them."""
    inside = F.when(~outside_fences("value"), F.col("value"))
    return (_fenced(series, value, method).groupBy(*KEYS, "q1", F.col("q2").alias("median"), "q3")
            .agg(F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"),
                 F.count_if(outside_fences("value")).alias("fliers")))


def box_fliers(series: DataFrame, value: str = "mean", method: str = "percentile") -> DataFrame:
    """(machine, sensor, ts, value) of every value beyond the fences."""
    return _fenced(series, value, method).where(outside_fences("value")).select(*KEYS, "ts", "value")
