"""Outliers and anomalies against per-sensor statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import salted_join
from meterline.operators.profile import with_cells
from meterline.operators.quantiles import exact_quantiles

KEYS = ["machine", "sensor"]


def iqr_fences(series: DataFrame, value: str = "mean", method: str = "percentile") -> DataFrame:
    """(machine, sensor, q1, q2, q3, low_fence, high_fence)."""
    q = F.col("quantiles")
    quartiles = exact_quantiles(series, KEYS, value, [0.25, 0.5, 0.75], method).select(
        *KEYS, q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return (quartiles.withColumn("low_fence", F.col("q1") - reach)
            .withColumn("high_fence", F.col("q3") + reach))


def outside_fences(value: str) -> Column:
    return (F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence"))


def missing_and_outliers(series: DataFrame, value: str = "mean", method: str = "percentile",
                         frame: DataFrame | None = None) -> DataFrame:
    """(machine, sensor, missing_pct, outlier_pct), both over all cells (see ``profile``)."""
    fenced = salted_join(series, iqr_fences(series, value, method), KEYS, "ts", how="left")
    counts = fenced.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("cells"), F.count(value).alias("points"),
        F.count_if(outside_fences(value)).alias("outliers"))
    cells = F.col("cells")
    return with_cells(counts, frame).select(
        *KEYS, (F.try_divide(cells - F.col("points"), cells) * 100).alias("missing_pct"),
        (F.try_divide(F.col("outliers"), cells) * 100).alias("outlier_pct"))


def iqr_outliers(series: DataFrame, value: str = "mean", method: str = "percentile",
                 frame: DataFrame | None = None) -> DataFrame:
    """(machine, sensor, outlier_pct): share over all cells, NULL ones included."""
    return missing_and_outliers(series, value, method, frame).drop("missing_pct")


def _with_moments(series: DataFrame, value: str, how: str) -> DataFrame:
    moments = series.groupBy(*KEYS).agg(F.avg(value).alias("_avg"), F.stddev_samp(value).alias("_std"))
    return salted_join(series, moments, KEYS, "ts", how=how)


def far_from_mean(value: str, k: float) -> Column:
    """More than *k* deviations away; written without a division, so a zero deviation is no error."""
    return F.abs(F.col(value) - F.col("_avg")) > F.col("_std") * k


def zscore_outliers(series: DataFrame, k: float = 3.0, value: str = "mean") -> DataFrame:
    """(machine, sensor, outliers): number of values beyond *k* sample deviations."""
    return (_with_moments(series, value, "left").groupBy(*KEYS)
            .agg(F.count_if(far_from_mean(value, k)).alias("outliers")))


def anomalies(series: DataFrame, k: float = 2.0, value: str = "mean") -> DataFrame:
    """(machine, sensor, ts, value): the rows beyond *k* sample deviations."""
    return (_with_moments(series, value, "inner").where(far_from_mean(value, k))
            .select(*KEYS, "ts", F.col(value).alias("value")))
