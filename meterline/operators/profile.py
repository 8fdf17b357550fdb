"""General profile and completeness of a series (machine, sensor, ts, <value>).

A series is either a grid, which has a row for every cell, or the sparse form of a
rollup.  For the sparse form pass ``frame`` (``machine_frame``): the cells of a sensor
are then the machine's ticks and no grid needs to be built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.operators.quantiles import bin_moments, exact_quantiles, value_bins
from meterline.session import settle

KEYS = ["machine", "sensor"]
QUARTILES = [0.25, 0.5, 0.75]


def with_cells(per_sensor: DataFrame, frame: DataFrame | None) -> DataFrame:
    """Per-sensor rows with ``cells`` from the machine's ticks instead of from the rows seen."""
    if frame is None:
        return per_sensor
    return per_sensor.drop("cells").join(frame.select("machine", F.col("rows").alias("cells")), "machine")


def _counts(series: DataFrame, value: str, frame: DataFrame | None) -> DataFrame:
    counted = series.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("cells"), F.count(value).alias("points"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return with_cells(counted, frame).withColumn(
        "missing_pct", F.try_divide(F.col("cells") - F.col("points"), F.col("cells")) * 100)


def points_per_sensor(series: DataFrame, value: str = "mean") -> DataFrame:
    return series.groupBy(*KEYS).agg(F.count(value).alias("points"))


def general_info(series: DataFrame, value: str = "mean", frame: DataFrame | None = None) -> DataFrame:
    """Per machine: date range, cells, missing cells and their share, sensor count."""
    totals = _counts(series, value, frame).groupBy("machine").agg(
        F.min("first_ts").alias("min_ts"), F.max("last_ts").alias("max_ts"),
        F.sum("cells").alias("total_points"), F.sum(F.col("cells") - F.col("points")).alias("missing"),
        F.count(F.lit(1)).alias("sensors"))
    return totals.withColumn("missing_pct", F.try_divide(F.col("missing"), F.col("total_points")) * 100)


def describe(series: DataFrame, value: str = "mean", method: str = "percentile", bins: DataFrame | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per sensor, NULLs ignored.

    ``method='refine'`` is for raw readings (see ``exact_quantiles``): all but the quartiles comes from the value
    bins, so the readings are read twice, or once with stored *bins*.  A sensor without a value then has no row
    in the bins; its numbers are NULL and its count 0.
    """
    x = F.col(value).cast("double")
    basics = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
              F.min(x).alias("min"), F.max(x).alias("max")]
    if method == "percentile":
        stats = series.groupBy(*KEYS).agg(
            *basics, F.percentile(x, F.array(*map(F.lit, QUARTILES))).alias("quantiles"))
    else:
        bins = settle(value_bins(series, KEYS, value) if bins is None else bins, "bins")
        stats = bin_moments(bins, KEYS).join(exact_quantiles(series, KEYS, value, QUARTILES, method, bins=bins), KEYS, "left")
    q = F.col("quantiles")
    return stats.select(*KEYS, "n", "mean", "std", "min", q[0].alias("p25"), q[1].alias("p50"),
                        q[2].alias("p75"), "max")


def missing_share(series: DataFrame, value: str = "mean", frame: DataFrame | None = None) -> DataFrame:
    """Missing percentage per sensor."""
    return _counts(series, value, frame).select(
        *KEYS, "missing_pct", F.when(F.col("missing_pct") > 0, "missing_values").otherwise("ok").alias("status"))


def completeness(series: DataFrame, threshold: float = 90.0, value: str = "mean",
                 frame: DataFrame | None = None) -> DataFrame:
    """Per sensor: completeness, the machine's overall completeness and whether it is below *threshold*.

    Overall is 100 minus the mean of the per-sensor missing percentages.
    """
    machine = Window.partitionBy("machine")
    return _counts(series, value, frame).select(
        *KEYS, "missing_pct", (100 - F.col("missing_pct")).alias("complete_pct"),
        (100 - F.avg("missing_pct").over(machine)).alias("overall_pct"),
        (F.col("missing_pct") > 100 - threshold).alias("below_threshold"))


def missing_summary(missing: DataFrame) -> DataFrame:
    """Chart data: missing readings and percentage, sensors in name order."""
    return missing.select(*KEYS, "missing", "missing_pct").orderBy(*KEYS)
