"""Composite reports: what an operations team asks of one set of machines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import salted_join, violates_limits
from meterline.operators import correlation as corr
from meterline.operators import distribution, invalid, missing, outliers, profile, timeseries
from meterline.operators.consistency import duplicate_ticks, infer_frequency, timestamp_order
from meterline.operators.dictionary import limits, machine_groups, machine_tags, present_tags, sensors_per_group
from meterline.operators.reshape import annotated_to_wide, select_sensors, wide_to_long
from meterline.operators.rollup import annotate, as_series, machine_frame, machine_grid, ticks
from meterline.schema import QualityConfig
from meterline.session import settle

KEYS = ["machine", "sensor"]


@dataclass(frozen=True)
class Loaded:
    """A machine's data, ready for the reports; every member is lazy."""

    rollup: DataFrame
    grid: DataFrame
    annotated: DataFrame
    frequency: DataFrame
    tags: DataFrame
    groups: DataFrame
    sensor_counts: DataFrame

    def export(self, sensors: list[str] | None = None) -> DataFrame:
        return annotated_to_wide(self.annotated, sensors)


def load_machine(wide: DataFrame, machine, dictionary: DataFrame, config: QualityConfig = QualityConfig(),
                 group: str | None = None, ts: str = "timestamp") -> Loaded:
    """Wide aggregate table + dictionary -> annotated data, frequency and matching tags."""
    return load_rollup(wide_to_long(wide, machine, ts, config.flag_meaning), dictionary, config, group)


def load_rollup(rolled: DataFrame, dictionary: DataFrame, config: QualityConfig = QualityConfig(),
                group: str | None = None) -> Loaded:
    grid = machine_grid(rolled, config.orig_freq_s)
    tags = present_tags(dictionary, rolled)
    groups, counts = machine_groups(tags), sensors_per_group(tags)
    if group is not None:
        tags = machine_tags(tags, group)
    return Loaded(rolled, grid, annotate(grid), infer_frequency(ticks(rolled), config.orig_freq_s),
                  tags, groups, counts)


def _tidy(stats: DataFrame, keys: list[str], metrics: dict[str, tuple[str, object, object]]) -> DataFrame:
    """Stat columns -> rows (machine, sensor, check, metric, value, status); NULL values are kept."""
    cells = F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(metric).alias("metric"),
                 value.cast("double").alias("value"), status.alias("status"))
        for metric, (check, value, status) in metrics.items()])
    sensor = F.col("sensor") if "sensor" in keys else F.lit(None).cast("string").alias("sensor")
    return stats.select("machine", sensor, F.inline(cells))


def _missing_pct():
    return F.try_divide(F.col("cells") - F.col("points"), F.col("cells")) * 100


def profile_rows(stats: DataFrame, config: QualityConfig) -> DataFrame:
    """Report rows of per-sensor statistics (points, cells, first_ts, last_ts, _avg, _std, x0, x1, q) and of their machines."""
    ok = F.lit("ok")
    missing_pct = _missing_pct()
    incomplete = missing_pct > 100 - config.completeness_threshold
    rows = _tidy(stats, KEYS, {
        "points": ("general", F.col("points"), ok),
        "mean": ("describe", F.col("_avg"), ok), "std": ("describe", F.col("_std"), ok),
        "min": ("describe", F.col("x0"), ok), "p25": ("describe", F.col("q")[0], ok),
        "p50": ("describe", F.col("q")[1], ok), "p75": ("describe", F.col("q")[2], ok),
        "max": ("describe", F.col("x1"), ok),
        "missing_pct": ("missing", missing_pct, F.when(missing_pct > 0, "missing_values").otherwise(ok)),
        "complete_pct": ("completeness", 100 - missing_pct,
                         F.when(incomplete, "below_threshold").otherwise(ok)),
    })

    totals = stats.groupBy("machine").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("sensors"), F.sum("cells").alias("cells"), F.sum("points").alias("points"),
        F.avg(missing_pct).alias("avg_missing"))
    overall = 100 - F.col("avg_missing")
    return rows.unionByName(_tidy(totals, ["machine"], {
        "start_epoch_s": ("general", F.unix_timestamp(F.col("first_ts").cast("timestamp")), ok),
        "end_epoch_s": ("general", F.unix_timestamp(F.col("last_ts").cast("timestamp")), ok),
        "sensors": ("general", F.col("sensors"), ok), "total_points": ("general", F.col("cells"), ok),
        "total_missing": ("general", F.col("cells") - F.col("points"), ok),
        "total_missing_pct": ("general", F.try_divide(F.col("cells") - F.col("points"), F.col("cells")) * 100, ok),
        "overall_complete_pct": ("completeness", overall,
                                 F.when(overall < config.completeness_threshold, "below_threshold").otherwise(ok)),
    }))


def deviation_rows(judged: DataFrame) -> DataFrame:
    """Report rows of per-sensor counts (known, cells, points, outliers, zscore_outliers, issues)."""
    ok = F.lit("ok")
    issue_pct = F.try_divide(F.col("issues"), F.col("points")) * 100
    return _tidy(judged, KEYS, {
        "outlier_pct": ("outliers", F.try_divide(F.col("outliers"), F.col("cells")) * 100,
                        F.when(F.col("outliers") > 0, "outliers").otherwise(ok)),
        "zscore_outliers": ("outliers", F.col("zscore_outliers"),
                            F.when(F.col("zscore_outliers") > 0, "outliers").otherwise(ok)),
    }).unionByName(_tidy(judged.where("known"), KEYS, {
        "issue_pct": ("accuracy", issue_pct, F.when(F.col("points") == 0, "no_valid_data")
                      .when(F.col("issues") > 0, "accuracy_issues").otherwise(ok)),
    }))


def quality_report(rolled: DataFrame, dictionary: DataFrame, config: QualityConfig = QualityConfig(),
                   readings: DataFrame | None = None) -> DataFrame:
    """Tidy data-quality report (machine, sensor, check, metric, value, status) of a stored rollup.

    One aggregation for the profile, one more pass against it for outliers and
    accuracy, then duplicates, timestamp order (of *readings* in arrival order, when
    given) and correlation.  No grid: cells without a reading follow from the tick count.
    The profile, one row per sensor, is settled because two passes use it.
    """
    ok = F.lit("ok")
    x = F.col("mean")
    series = as_series(rolled)
    known = limits(dictionary).select("sensor", "low_limit", "high_limit", F.lit(True).alias("known"))
    stats = series.groupBy(*KEYS).agg(
        F.count(x).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg(x).alias("_avg"), F.stddev_samp(x).alias("_std"), F.min(x).alias("x0"), F.max(x).alias("x1"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    stats = settle(profile.with_cells(stats, machine_frame(rolled, config.orig_freq_s))
                   .join(known, "sensor", "left"), "profile")
    reach = (F.col("q")[2] - F.col("q")[0]) * 1.5
    fenced = stats.withColumn("low_fence", F.col("q")[0] - reach).withColumn("high_fence", F.col("q")[2] + reach)

    judged = salted_join(series.select(*KEYS, "ts", "mean"), fenced.drop("points"), KEYS, "ts").groupBy(
        *KEYS, "known", "cells").agg(
        F.count_if(outliers.outside_fences("mean")).alias("outliers"),
        F.count_if(outliers.far_from_mean("mean", config.zscore_k)).alias("zscore_outliers"),
        F.count("mean").alias("points"), F.count_if(violates_limits("mean")).alias("issues"))
    duplicate_rows = _tidy(duplicate_ticks(series), ["machine"], {
        name: ("duplicates", F.col(name), F.when(F.col("dup_rows") > 0, "duplicates").otherwise(ok))
        for name in ("dup_rows", "dup_half", "dup_extra", "dup_pct")})

    pairs = corr.strong_pairs(corr.correlation(series, bucket=config.bucket), config.strong_correlation)
    pair_rows = pairs.select("machine", F.col("sensor_a").alias("sensor"), F.lit("correlation").alias("check"),
                             F.concat(F.lit("r:"), F.col("sensor_b")).alias("metric"),
                             F.col("r").alias("value"), F.lit("strong").alias("status"))

    report = (profile_rows(stats, config).unionByName(deviation_rows(judged))
              .unionByName(duplicate_rows).unionByName(pair_rows))
    if readings is not None:
        order = _tidy(timestamp_order(readings), ["machine"], {
            name: ("timestamp_order", F.col(name), F.col("status"))
            for name in ("n_backward", "n_equal")})
        report = report.unionByName(order)
    return report


@dataclass(frozen=True)
class MissingReport:
    readings: DataFrame
    intervals: DataFrame
    gaps: DataFrame
    summary: DataFrame


def missing_report(rolled: DataFrame, grid: DataFrame, config: QualityConfig = QualityConfig()) -> MissingReport:
    """Missing readings, their periods, the period list per sensor and one summary row per sensor."""
    readings = missing.missing_readings(rolled, config)
    intervals = missing.missing_intervals(grid, config)
    gaps = missing.gap_list(intervals, readings)
    per_sensor = intervals.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("periods"), F.sum("n_buckets").alias("bad_buckets"),
        F.max("n_buckets").alias("longest_buckets"))
    zero = F.lit(0).cast("bigint")
    summary = readings.join(per_sensor, KEYS, "left").select(
        *KEYS, "expected", "missing", "missing_pct", F.coalesce("periods", zero).alias("periods"),
        F.coalesce("bad_buckets", zero).alias("bad_buckets"),
        F.coalesce("longest_buckets", zero).alias("longest_buckets"))
    return MissingReport(readings, intervals, gaps, summary)


@dataclass(frozen=True)
class InvalidReport:
    totals: DataFrame
    by_sensor: DataFrame
    buckets: DataFrame
    summary: DataFrame


def invalid_report(rolled: DataFrame, config: QualityConfig = QualityConfig()) -> InvalidReport:
    """Alarm totals, alarms per sensor, the alarming buckets, and a per-sensor summary of both."""
    threshold = config.alarm_threshold
    summary = rolled.groupBy(*KEYS).agg(
        F.sum("n_invalid").alias("alarms"), F.count_if(F.col("n_invalid") >= threshold).alias("alarm_buckets"),
        F.max("n_invalid").alias("worst_bucket"))
    return InvalidReport(invalid.alarm_totals(rolled, machine_frame(rolled, config.orig_freq_s)),
                         invalid.alarms_by_sensor(rolled),
                         invalid.alarm_buckets(annotate(rolled), threshold), summary.where("worst_bucket > 0"))


@dataclass(frozen=True)
class Exploration:
    describe: DataFrame
    zscore: DataFrame
    correlation: DataFrame
    limits: DataFrame
    histogram: DataFrame
    density: DataFrame
    box: DataFrame
    fliers: DataFrame
    anomalies: DataFrame
    series: DataFrame
    season_period: int

    @cached_property
    def decomposition(self) -> DataFrame:
        """Stores its first pass, so it is built when it is first asked for."""
        return timeseries.seasonal_decompose(self.series, self.season_period)


def explore(grid: DataFrame, dictionary: DataFrame, sensors: list[str] | None = None,
            config: QualityConfig = QualityConfig()) -> Exploration:
    """Everything the exploration page shows for the chosen sensors; each part runs on its own."""
    series = select_sensors(grid, sensors) if sensors else grid
    return Exploration(
        describe=profile.describe(series),
        zscore=outliers.zscore_outliers(series, config.zscore_k),
        correlation=corr.correlation(series, bucket=config.bucket),
        limits=timeseries.series_with_limits(series, dictionary, config.rolling_rows),
        histogram=distribution.histogram(series),
        density=distribution.density(series),
        box=distribution.box_stats(series),
        fliers=distribution.box_fliers(series),
        anomalies=outliers.anomalies(series, config.anomaly_k), series=series, season_period=config.season_period)
