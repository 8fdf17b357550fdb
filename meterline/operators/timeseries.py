"""Rolling statistics and seasonal decomposition.

Series come from a grid: ``idx`` numbers a sensor's rows without holes.  Frames of
a few rows then need only a few neighbours, so a series is cut into runs of
``chunk_rows`` rows, each run borrows the rows its frames reach over the seam, and
one sensor's series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import salted_join
from meterline.operators.dictionary import limits
from meterline.session import settle

KEYS = ["machine", "sensor"]
CHUNK_ROWS = 4096


def _in_runs(series: DataFrame, before: int, after: int, chunk_rows: int) -> DataFrame:
    """Adds ``run``; rows near a seam also appear, as guests, in the neighbouring run."""
    if max(before, after) > chunk_rows:
        raise ValueError("chunk_rows must cover the frame")
    home = F.expr(f"idx div {chunk_rows}")
    place = F.col("idx") % chunk_rows
    runs = [home]
    if before:
        runs.append(F.when(place >= chunk_rows - before, home + 1))
    if after:
        runs.append(F.when((place < after) & (home > 0), home - 1))
    return (series.withColumn("run", F.explode(F.array_compact(F.array(*runs))))
            .withColumn("is_home", F.col("run") == home))


def rolling(series: DataFrame, rows: int = 24, value: str = "mean", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(machine, sensor, ts, value, rolling_mean, rolling_std) over the last *rows* rows.

    NULL until the frame holds *rows* non-null values.
    """
    frame = Window.partitionBy(*KEYS, "run").orderBy("idx").rowsBetween(-(rows - 1), 0)
    full = F.count("value").over(frame) == rows
    cut = _in_runs(series.select(*KEYS, "ts", "idx", F.col(value).alias("value")), rows - 1, 0, chunk_rows)
    return (
        cut.withColumn("rolling_mean", F.when(full, F.avg("value").over(frame)))
        .withColumn("rolling_std", F.when(full, F.stddev_samp("value").over(frame)))
        .where("is_home").select(*KEYS, "ts", "value", "rolling_mean", "rolling_std")
    )


def rolling_mean(series: DataFrame, rows: int = 24, value: str = "mean", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return rolling(series, rows, value, chunk_rows).drop("rolling_std")


def rolling_std(series: DataFrame, rows: int = 24, value: str = "mean", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return rolling(series, rows, value, chunk_rows).drop("rolling_mean")


def series_with_limits(series: DataFrame, dictionary: DataFrame, rows: int = 24, value: str = "mean",
                       chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(machine, sensor, ts, value, rolling_mean, low_limit, high_limit)."""
    known = limits(dictionary).select("sensor", "low_limit", "high_limit")
    return (rolling_mean(series, rows, value, chunk_rows).join(known, "sensor", "left")
            .select(*KEYS, "ts", "value", "rolling_mean", "low_limit", "high_limit"))


def _status(rows: Column, points: Column, period: int) -> Column:
    return F.when(points < rows, "has_nulls").when(rows < 2 * period, "too_short").otherwise("ok")


def decomposition_status(series: DataFrame, period: int = 24, value: str = "mean") -> DataFrame:
    """(machine, sensor, status): ok, has_nulls, or too_short for two periods."""
    return series.groupBy(*KEYS).agg(_status(F.count(F.lit(1)), F.count(value), period).alias("status"))


def seasonal_decompose(series: DataFrame, period: int = 24, value: str = "mean",
                       chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Additive decomposition: (machine, sensor, ts, status, observed, trend, seasonal, resid).

    Trend is the centred moving average of one period (half weights at both ends when
    the period is even), NULL where it does not fit.  Seasonal is the mean detrended
    value of the phase, centred over the phases.  Sensors that cannot be decomposed
    keep their rows, with NULL components and the reason in ``status``.
    """
    half = period // 2
    rows = series.select(*KEYS, "ts", "idx", F.col(value).alias("observed"))
    order = Window.partitionBy(*KEYS, "run").orderBy("idx")
    centred = order.rowsBetween(-half, half)
    total = F.sum("observed").over(centred)
    if period % 2 == 0:
        ends = F.lag("observed", half).over(order) + F.lead("observed", half).over(order)
        total = total - ends * 0.5
    fits = F.count("observed").over(centred) == 2 * half + 1
    # Stored, because the phase means need all of it before any row can be finished.
    trended = settle(
        _in_runs(rows, half, half, chunk_rows)
        .withColumn("trend", F.when(fits, total / period))
        .where("is_home")
        .select(*KEYS, "ts", (F.col("idx") % period).alias("phase"), "observed", "trend"), "trend")
    phases = trended.groupBy(*KEYS, "phase").agg(
        F.avg(F.col("observed") - F.col("trend")).alias("mean_detrended"),
        F.count(F.lit(1)).alias("rows"), F.count("observed").alias("points"))
    whole = Window.partitionBy(*KEYS)
    seasons = phases.select(
        *KEYS, "phase", (F.col("mean_detrended") - F.avg("mean_detrended").over(whole)).alias("seasonal"),
        _status(F.sum("rows").over(whole), F.sum("points").over(whole), period).alias("status"))
    ok = F.col("status") == "ok"
    joined = salted_join(trended, seasons, [*KEYS, "phase"], "ts", salts=4)
    return joined.select(
        *KEYS, "ts", "status", "observed", F.when(ok, F.col("trend")).alias("trend"),
        F.when(ok, F.col("seasonal")).alias("seasonal"),
        F.when(ok, F.col("observed") - F.col("trend") - F.col("seasonal")).alias("resid"))
