"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions import digits_only
from meterline.operators import (
    accuracy, consistency, correlation, dictionary, distribution, invalid, missing, outliers, profile, quantiles, reshape,
    rollup, strong, timeseries,
)
from meterline.plans import reports
from meterline.schema import QualityConfig
from meterline.session import scratch_path, settle
from meterline.sources import dictionary as dictionary_reader
from meterline.sources import incremental, tables
from meterline.sources.tables import as_readings
from meterline.streaming import history, jobs
from workload import inputs
from workload.inputs import EVENTS, LINES

# Synthetic sensors hardly correlate: the reports list pairs from a low bound on.
REPORTED = replace(EVENTS, strong_correlation=0.04)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Registers a query under its name; bucket arithmetic needs a zone without clock changes."""
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six decimals off the half-way points: engines add up in different orders."""
    for name in names:
        df = df.withColumn(name, round6(F.col(name)))
    return df


def round6(c: Column) -> Column:
    return F.round(c + F.lit(1e-9), 6)


def zoneless(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


# -- rollup, reshape, export -------------------------------------------------

@query
def hourly_rollup(spark, sf):
    return rounded(inputs.event_rollup(spark, sf), "sum_v")


@query
def daily_rollup_from_hourly(spark, sf):
    hourly = inputs.event_rollup(spark, sf, extremes=True)
    return rounded(rollup.merge_rollup(hourly, "1 day"), "sum_v")


@query
def rollup_by_rule(spark, sf):
    rolled = rollup.apply_aggregation_rule(
        inputs.event_rollup(spark, sf, extremes=True), inputs.event_dictionary(spark))
    return rounded(rolled, "agg_value").select("machine", "sensor", "bucket_start", "aggregation_rule", "agg_value")


@query
def annotate_mean(spark, sf):
    return rounded(rollup.annotate(inputs.event_grid(spark, sf, judged=True)), "mean")


@query
def wide_round_trip(spark, sf):
    """The rollup as a wide machine table and back to long form; cells without a reading come back with zero counts."""
    wide = reshape.rollup_to_wide(settle(inputs.event_rollup(spark, sf), "hourly"))
    return rounded(reshape.wide_to_long(wide, F.col("machine")), "sum_v")


@query
def missing_intervals_from_wide(spark, sf):
    """The gaps found over the wide table are those of the rollup itself."""
    wide = settle(reshape.rollup_to_wide(settle(inputs.event_rollup(spark, sf, judged=False), "hourly")), "wide")
    long = settle(reshape.wide_to_long(wide, F.col("machine")), "long")
    return missing.missing_intervals(rollup.machine_grid(long, EVENTS.orig_freq_s), EVENTS)


@query
def machine_table_from_files(spark, sf):
    """A wide machine table written as files, with upper-case columns as a database may have them, and read back."""
    path = scratch_path(spark, "machine-files")
    wide = reshape.rollup_to_wide(settle(inputs.event_rollup(spark, sf), "hourly"))
    wide.toDF(*[c.upper() for c in wide.columns]).write.parquet(path)
    return rounded(reshape.wide_to_long(tables.read_machine_files(spark, path), F.col("machine")), "sum_v")


@query
def machine_table_from_catalogue(spark, sf):
    """Hourly machine tables of the catalogue, found by name, each read back: (machine, sensor, cells, points)."""
    database = f"plant_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'plant')}'")
    hourly = settle(inputs.event_rollup(spark, sf), "hourly")
    for machine in ("m0", "m1"):
        wide = reshape.rollup_to_wide(hourly.where(F.col("machine") == machine)).drop("machine")
        wide.write.saveAsTable(f"{database}.{machine}_hours")
    hourly.write.saveAsTable(f"{database}.raw_readings")
    found = None
    for name in tables.machine_tables(spark, database):
        long = reshape.wide_to_long(tables.read_machine_table(spark, f"{database}.{name}"), name.removesuffix("_hours"))
        counts = long.groupBy("machine", "sensor").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points"))
        found = counts if found is None else found.unionByName(counts)
    return found


@query
def dictionary_from_csv(spark, sf):
    """The part dictionary as a CSV file with its header in another order and case, read by name."""
    path = scratch_path(spark, "dictionary-csv")
    parts = inputs.part_dictionary(spark, sf)
    order = [*reversed(parts.columns)]
    parts.select(*order).toDF(*[c.upper().replace("_", " ") if c == "tag_description" else c.upper() for c in order]).write.option(
        "header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return dictionary_reader.read_dictionary(spark, path)


@query
def wide_export(spark, sf):
    grid = settle(inputs.event_grid(spark, sf, judged=True), "grid")  # the pivot first asks for the sensor ids
    return tables.csv_round_trip(rollup.annotate(grid))


@query
def wide_export_lines(spark, sf):
    """Export without a pivot, for any number of sensors, written and read back."""
    path = scratch_path(spark, "wide-lines")
    tables.write_wide_csv(settle(rollup.annotate(inputs.event_grid(spark, sf, judged=True)), "annotated"), path)
    return tables.read_wide_csv(spark, path)


@query
def combined_means_and_alarms(spark, sf):
    """Hourly means beside daily alarms, whole tables: most rows have one side only, midnights both."""
    hourly = settle(inputs.event_rollup(spark, sf), "hourly")
    daily = rollup.annotate(rollup.merge_rollup(hourly, "1 day"))
    return rounded(reshape.combine_means_and_alarms(rollup.annotate(hourly).drop("alarms"), daily.drop("mean")), "mean")


@query
def selected_sensors(spark, sf):
    readings = reshape.select_sensors(inputs.event_readings(spark, sf), ["click", "error"])
    return readings.groupBy("machine", "sensor").agg(F.count("value").alias("points"))


# -- dictionary --------------------------------------------------------------

@query
def tags_with_data(spark, sf):
    return dictionary.present_tags(inputs.part_dictionary(spark, sf), inputs.part_readings(spark, sf))


@query
def tags_of_machine(spark, sf):
    return dictionary.machine_tags(inputs.part_dictionary(spark, sf), "Brand#2")


@query
def tags_of_machine_by_pattern(spark, sf):
    return dictionary.machine_tags(inputs.part_dictionary(spark, sf), "Brand#2", contains=True)


@query
def machine_groups(spark, sf):
    return dictionary.machine_groups(inputs.part_dictionary(spark, sf))


@query
def sensors_per_group(spark, sf):
    return dictionary.sensors_per_group(inputs.part_dictionary(spark, sf))


@query
def tag_limits(spark, sf):
    return dictionary.limits(inputs.part_dictionary(spark, sf)).select(
        "sensor", "threshold_type", "low_limit", "high_limit")


@query
def sensor_labels(spark, sf):
    sensors = inputs.part_readings(spark, sf).select("sensor").distinct()
    labelled = dictionary.labels(sensors, inputs.part_dictionary(spark, sf))
    return labelled.withColumn("digits", digits_only("sensor"))


@query
def metadata_lint(spark, sf):
    # Parts listed again make repeated tags, some with another upper limit.
    parts = inputs.part_dictionary(spark, sf)
    again = parts.where("category = 'ECONOMY'").withColumn(
        "high_threshold", F.when(F.col("tag").like("%3"), "7").otherwise(F.col("high_threshold")))
    return dictionary.metadata_lint(parts.unionByName(again))


@query
def unmatched_sensors(spark, sf):
    return dictionary.unmatched_sensors(inputs.part_readings(spark, sf), inputs.part_dictionary(spark, sf))


# -- profile and completeness ------------------------------------------------

@query
def infer_freq(spark, sf):
    hourly = rollup.ticks(inputs.event_rollup(spark, sf, judged=False))
    return consistency.infer_frequency(hourly, EVENTS.orig_freq_s)


@query
def time_steps(spark, sf):
    return consistency.time_steps(rollup.ticks(inputs.event_rollup(spark, sf, judged=False)))


@query
def general_info(spark, sf):
    series = inputs.stored_event_series(spark, sf)
    return rounded(profile.general_info(series, frame=inputs.frame_of(series)), "missing_pct")


@query
def points_per_sensor(spark, sf):
    return profile.points_per_sensor(rollup.as_series(inputs.event_rollup(spark, sf, judged=False)))


@query
def describe_stats(spark, sf):
    series = inputs.stable_mean(rollup.as_series(inputs.event_rollup(spark, sf, judged=False)))
    return rounded(profile.describe(series), "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def describe_raw_readings(spark, sf):
    """Raw rows, without a rollup: quartiles by refined counts, no sensor gathered in one task."""
    stats = profile.describe(inputs.line_readings(spark, sf), "value", method="refine")
    return rounded(stats, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def missing_pct(spark, sf):
    series = inputs.stored_event_series(spark, sf)
    return rounded(profile.missing_share(series, frame=inputs.frame_of(series)), "missing_pct")


@query
def completeness(spark, sf):
    series = inputs.stored_event_series(spark, sf)
    result = profile.completeness(series, 77.7, frame=inputs.frame_of(series))
    return rounded(result, "missing_pct", "complete_pct", "overall_pct")


@query
def duplicates(spark, sf):
    """Duplicate ticks: machine records whose sensor values all repeat (here: readings per hour)."""
    counts = settle(inputs.event_counts(spark, sf), "hourly-counts")
    return rounded(consistency.duplicate_ticks(counts), "dup_half", "dup_pct")


@query
def duplicate_measurements(spark, sf):
    lines = inputs.table(spark, sf, "lineitem")
    return rounded(consistency.duplicate_records(lines, ["l_quantity", "l_discount", "l_tax"]), "dup_pct")


@query
def duplicate_texts(spark, sf):
    documents = inputs.table(spark, sf, "documents")
    return rounded(consistency.duplicate_records(documents, ["text"], by=["lang"]), "dup_pct")


@query
def timestamp_order(spark, sf):
    return consistency.timestamp_order(inputs.order_readings(spark, sf))


@query
def timestamp_order_events(spark, sf):
    return consistency.timestamp_order(inputs.event_readings(spark, sf))


# -- missing readings --------------------------------------------------------

@query
def missing_readings(spark, sf):
    return rounded(missing.missing_readings(inputs.event_rollup(spark, sf, judged=False), EVENTS), "missing_pct")


@query
def missing_readings_by_buckets(spark, sf):
    config = QualityConfig(orig_freq_s=LINES.orig_freq_s, bucket=LINES.bucket, expected_mode="buckets")
    daily = rollup.rollup(inputs.line_readings(spark, sf), bucket=config.bucket)
    return rounded(missing.missing_readings(daily, config), "missing_pct")


@query
def missing_intervals(spark, sf):
    return missing.missing_intervals(inputs.event_grid(spark, sf), EVENTS)


@query
def missing_intervals_calendar(spark, sf):
    """Also the days on which a whole machine was silent."""
    daily = settle(rollup.rollup(inputs.line_readings(spark, sf), bucket=LINES.bucket), "daily")
    return missing.missing_intervals(rollup.calendar_grid(daily, LINES.bucket, LINES.orig_freq_s), LINES)


@query
def missing_report(spark, sf):
    stored = settle(inputs.event_rollup(spark, sf, judged=False), "hourly")
    grid = rollup.machine_grid(stored, EVENTS.orig_freq_s)
    return rounded(reports.missing_report(stored, grid, EVENTS).summary, "missing_pct")


@query
def missing_summary(spark, sf):
    result = profile.missing_summary(missing.missing_readings(inputs.event_rollup(spark, sf, judged=False), EVENTS))
    return rounded(result, "missing_pct")


@query
def gap_list(spark, sf):
    stored = settle(inputs.event_rollup(spark, sf, judged=False), "hourly")
    found = missing.missing_intervals(rollup.machine_grid(stored, EVENTS.orig_freq_s), EVENTS)
    listed = missing.gap_list(found, stored)
    one = F.expr("transform(gaps, g -> concat(date_format(g.gap_start, 'yyyy-MM-dd HH:mm:ss'), '..', "
                 "date_format(g.gap_end, 'yyyy-MM-dd HH:mm:ss')))")
    return listed.select("machine", "sensor", F.array_join(one, ";").alias("gaps"), "status")


# -- alarms and accuracy -----------------------------------------------------

@query
def alarm_stats(spark, sf):
    stored = settle(inputs.event_rollup(spark, sf), "hourly")
    return rounded(invalid.alarm_totals(stored, rollup.machine_frame(stored, EVENTS.orig_freq_s)), "avg_alarms")


@query
def alarm_by_sensor(spark, sf):
    return invalid.alarms_by_sensor(inputs.event_rollup(spark, sf))


@query
def invalid_counts(spark, sf):
    return rounded(invalid.invalid_counts(inputs.event_rollup(spark, sf), EVENTS.agg_freq), "invalid_pct")


@query
def invalid_buckets(spark, sf):
    annotated = rollup.annotate(inputs.event_rollup(spark, sf))
    return rounded(invalid.alarm_buckets(annotated, 2), "mean")


@query
def means_at_bad_buckets(spark, sf):
    stored = settle(rollup.annotate(inputs.event_rollup(spark, sf)), "annotated")
    return rounded(invalid.at_buckets(invalid.alarm_buckets(stored, 1), stored), "mean")


@query
def invalid_report(spark, sf):
    return reports.invalid_report(inputs.event_rollup(spark, sf), EVENTS).summary


@query
def accuracy_of_means(spark, sf):
    series = inputs.stable_mean(rollup.as_series(inputs.event_rollup(spark, sf, judged=False)))
    return rounded(accuracy.accuracy(series, inputs.event_dictionary(spark)), "issue_pct")


@query
def accuracy_issues(spark, sf):
    result = accuracy.accuracy_issues(
        inputs.part_readings(spark, sf), inputs.part_dictionary(spark, sf), "value")
    return rounded(result, "issue_pct")


@query
def accuracy_measured(spark, sf):
    """Only sensors that a sketch finds hot are spread over tasks."""
    found = accuracy.accuracy(inputs.part_readings(spark, sf), inputs.part_dictionary(spark, sf), "value", measured=True)
    return rounded(found.where("issues > 0"), "issue_pct")


@query
def hourly_rollup_measured(spark, sf):
    found = rollup.rollup(inputs.event_readings(spark, sf), inputs.event_dictionary(spark), EVENTS.bucket, measured=True)
    return rounded(found, "sum_v")


# -- outliers, distribution, correlation --------------------------------------

@query
def iqr_outliers(spark, sf):
    series = inputs.stored_event_series(spark, sf)
    return rounded(outliers.iqr_outliers(series, frame=inputs.frame_of(series)), "outlier_pct")


@query
def iqr_outliers_raw(spark, sf):
    readings = inputs.line_readings(spark, sf)
    return rounded(outliers.iqr_outliers(readings, "value", method="refine"), "outlier_pct")


@query
def zscore_outliers(spark, sf):
    return outliers.zscore_outliers(inputs.stored_event_series(spark, sf))


@query
def anomalies(spark, sf):
    return outliers.anomalies(inputs.stored_event_series(spark, sf))


@query
def missing_and_outliers(spark, sf):
    series = inputs.stored_event_series(spark, sf)
    result = outliers.missing_and_outliers(series, frame=inputs.frame_of(series))
    return rounded(result, "missing_pct", "outlier_pct")


@query
def histogram(spark, sf):
    bins = distribution.histogram(inputs.stored_event_series(spark, sf))
    return rounded(bins, "bin_low", "bin_high")


@query
def histogram_dense(spark, sf):
    """With the empty bins, as a chart shows them."""
    bins = distribution.histogram(inputs.stored_event_series(spark, sf), dense=True)
    return rounded(bins, "bin_low", "bin_high")


@query
def timestamp_order_unnumbered(spark, sf):
    """Readings without an arrival number, in the order they lie in the table's files."""
    return consistency.timestamp_order(inputs.line_readings(spark, sf, placed=True), by="stored")


@query
def timestamp_order_repeated_numbers(spark, sf):
    """Order numbers that every line of an order repeats: equal numbers are taken by their timestamps."""
    return consistency.timestamp_order(inputs.line_readings(spark, sf, number="l_orderkey"))


@query
def kde(spark, sf):
    return rounded(distribution.density(inputs.stored_event_series(spark, sf)), "x", "density")


@query
def kde_from_moments(spark, sf):
    return rounded(distribution.density(inputs.stored_event_series(spark, sf), method="moments"), "x", "density")


@query
def kde_of_raw_readings(spark, sf):
    """Density of the raw values themselves, at forty places."""
    readings = inputs.event_readings(spark, sf)
    return rounded(distribution.density(readings, "value", points=40, method="moments"), "x", "density")


@query
def box_stats(spark, sf):
    stats = distribution.box_stats(inputs.stored_event_series(spark, sf))
    return rounded(stats, "q1", "median", "q3", "low_whisker", "high_whisker")


@query
def box_fliers(spark, sf):
    return distribution.box_fliers(inputs.stored_event_series(spark, sf))


@query
def correlation_blocks(spark, sf):
    return rounded(correlation.correlation(inputs.stored_event_series(spark, sf)), "r")


@query
def correlation_pivot(spark, sf):
    sensors = ["click", "error", "purchase", "signup", "view"]
    series = inputs.stable_mean(rollup.as_series(inputs.event_rollup(spark, sf, judged=False)))
    return rounded(correlation.correlation_pivot(series, sensors), "r")


@query
def correlation_cells(spark, sf):
    series = inputs.stored_line_series(spark, sf)
    pairs = correlation.correlation(series, bucket=LINES.bucket, slice_ticks=2000)
    return rounded(correlation.correlation_cells(pairs, series), "r")


@query
def strong_pairs(spark, sf):
    pairs = correlation.correlation(inputs.stored_event_series(spark, sf))
    return rounded(correlation.strong_pairs(pairs, 0.04), "r")


@query
def strong_pairs_pruned(spark, sf):
    """Pairs of readings per hour, formed only where the leading coefficients allow them to be strong."""
    return rounded(strong.find_strong_pairs(inputs.event_counts(spark, sf), 0.04, least_group=2), "r")


@query
def strong_pairs_of_gappy_series(spark, sf):
    """Sensors with ticks of their own go through the blocked product."""
    return rounded(strong.find_strong_pairs(inputs.stored_event_series(spark, sf), 0.04, least_group=2), "r")


# -- time series ---------------------------------------------------------------

@query
def rolling_mean(spark, sf):
    return rounded(timeseries.rolling_mean(inputs.event_counts(spark, sf), chunk_rows=256), "rolling_mean")


@query
def rolling_mean_of_means(spark, sf):
    return rounded(timeseries.rolling_mean(inputs.line_grid(spark, sf), 7), "rolling_mean")


@query
def rolling_std(spark, sf):
    return rounded(timeseries.rolling_std(inputs.event_counts(spark, sf)), "rolling_std")


@query
def series_with_limits(spark, sf):
    result = timeseries.series_with_limits(
        inputs.event_counts(spark, sf), inputs.event_dictionary(spark))
    return rounded(result, "rolling_mean")


@query
def seasonal_decompose(spark, sf):
    result = timeseries.seasonal_decompose(inputs.event_counts(spark, sf), chunk_rows=256)
    return rounded(result, "trend", "seasonal", "resid")


@query
def decomposition_status(spark, sf):
    return timeseries.decomposition_status(inputs.event_grid(spark, sf))


# -- reports -------------------------------------------------------------------

@query
def quality_report(spark, sf):
    stored = inputs.stored_event_series(spark, sf).withColumnRenamed("ts", "bucket_start")
    report = reports.quality_report(
        stored, inputs.event_dictionary(spark), REPORTED, inputs.event_readings(spark, sf))
    return rounded(report, "value")


@query
def exploration_summary(spark, sf):
    """One row per sensor from the parts of the exploration page."""
    grid = settle(inputs.event_grid(spark, sf), "grid")
    page = reports.explore(grid, inputs.event_dictionary(spark), config=EVENTS)
    keys = ["machine", "sensor"]
    anomalous = page.anomalies.groupBy(*keys).agg(F.count(F.lit(1)).alias("anomalies"))
    summary = (page.describe.select(*keys, "n", "p50").join(page.zscore, keys)
               .join(page.box.select(*keys, "fliers", "high_whisker"), keys).join(anomalous, keys, "left"))
    return rounded(summary.withColumn("anomalies", F.coalesce("anomalies", F.lit(0).cast("bigint"))),
                   "p50", "high_whisker")


@query
def exploration_parts(spark, sf):
    """Every part of the exploration page: rows and a total per sensor (its values are compared part by part elsewhere)."""
    grid = settle(inputs.event_grid(spark, sf), "grid")
    page = reports.explore(grid, inputs.event_dictionary(spark), config=EVENTS)
    one, of = F.lit(1), {
        "describe": (page.describe, "n"), "zscore": (page.zscore, "outliers"),
        "correlation": (page.correlation.withColumnRenamed("sensor_a", "sensor"), "n_pairs"), "limits": (page.limits, "value"),
        "histogram": (page.histogram, "count"), "density": (page.density, "density"), "box": (page.box, "fliers"),
        "fliers": (page.fliers, "value"), "decomposition": (page.decomposition, "trend"), "anomalies": (page.anomalies, "value"),
    }
    parts = [part.groupBy("machine", "sensor").agg(F.count(one).alias("rows"), round6(F.sum(total).cast("double")).alias("total"))
             .select("machine", "sensor", F.lit(name).alias("part"), "rows", "total") for name, (part, total) in of.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query
def exploration_of_counts(spark, sf):
    """Decomposition part of the exploration page of readings per hour, a series without holes."""
    page = reports.explore(settle(inputs.event_counts(spark, sf), "counts"), inputs.event_dictionary(spark), config=EVENTS)
    parts = page.decomposition.groupBy("machine", "sensor").agg(
        F.count(F.lit(1)).alias("cells"), F.count("trend").alias("with_trend"), F.sum("trend").alias("trend"),
        F.sum(F.col("seasonal") * F.col("seasonal")).alias("seasonal_energy"), F.sum(F.col("resid") * F.col("resid")).alias("resid_energy"))
    return rounded(parts, "trend", "seasonal_energy", "resid_energy")


@query
def load_report(spark, sf):
    """Wide machine table -> annotated long data with frequency, as the loading page prepares it."""
    wide = settle(reshape.rollup_to_wide(inputs.event_rollup(spark, sf)), "wide")
    loaded = reports.load_machine(wide, F.col("machine"), inputs.event_dictionary(spark), EVENTS)
    annotated = loaded.annotated.join(loaded.frequency, "machine")
    tagged = annotated.join(loaded.tags.select(F.col("tag").alias("sensor"), "machine_group"), "sensor", "left")
    return rounded(tagged.groupBy("machine", "machine_group", "freq_s", "agg_freq").agg(
        F.count(F.lit(1)).alias("cells"), F.count("mean").alias("points"), F.sum("alarms").alias("alarms"),
        F.avg("mean").alias("avg_mean")), "avg_mean")


# -- streams -------------------------------------------------------------------

def _run(start: Callable, result: DataFrame, spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    start(result, f"{path}/table", f"{path}/state").awaitTermination()
    return f"{path}/table"


def _appended(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    return spark.read.schema(result.schema).parquet(_run(jobs.start_append, result, spark, name))


@query
def stream_rollup_equals_batch(spark, sf):
    rolled = jobs.stream_rollup(inputs.event_stream(spark, sf), inputs.event_dictionary(spark))
    path = _run(jobs.start_upsert, rolled, spark, "stream-upsert")
    return zoneless(rounded(jobs.latest(spark, path), "sum_v"), "bucket_start")


@query
def stream_rollup_closed(spark, sf):
    rolled = jobs.stream_rollup(inputs.event_stream(spark, sf), inputs.event_dictionary(spark))
    return zoneless(rounded(_appended(spark, rolled, "stream-closed"), "sum_v"), "bucket_start")


@query
def stream_alarms(spark, sf):
    alarms = jobs.stream_alarms(inputs.event_stream(spark, sf), inputs.event_dictionary(spark))
    return zoneless(rounded(_appended(spark, alarms, "stream-alarms"), "mean"), "ts")


@query
def stream_gaps(spark, sf):
    """Periods of short or silent buckets of every expected sensor, as the stream closes them."""
    sensors = inputs.expected_sensors(spark, sf)
    path = scratch_path(spark, "stream-gaps")
    jobs.start_gap_watch(jobs.stream_rollup(inputs.event_stream(spark, sf)), sensors, EVENTS, f"{path}/table", f"{path}/state").awaitTermination()
    return zoneless(jobs.closed_gaps(spark, f"{path}/table"), "gap_start", "gap_end")


@query
def stream_open_gaps(spark, sf):
    """Periods that go on when the stream has ended: of sensors that fell silent, and of a machine that never sent anything."""
    sensors = inputs.expected_sensors(spark, sf)
    dead = sensors.groupBy(F.lit("m-dead").alias("machine"), "sensor").agg(F.min("since").alias("since"))
    path = scratch_path(spark, "stream-open-gaps")
    jobs.start_gap_watch(jobs.stream_rollup(inputs.event_stream(spark, sf)), sensors.union(dead), EVENTS, f"{path}/table", f"{path}/state").awaitTermination()
    return zoneless(jobs.open_gaps(spark, f"{path}/table"), "gap_start")


@query
def stream_short_buckets(spark, sf):
    """The light form: runs of under-filled buckets that had a reading, by session windows alone."""
    gaps = jobs.stream_gaps(inputs.event_stream(spark, sf), EVENTS)
    return zoneless(_appended(spark, gaps, "stream-short"), "gap_start", "gap_end")


@query
def stream_first_readings(spark, sf):
    """Every reading sent twice, as by a feed that delivers at least once: each is kept once."""
    once = inputs.event_stream(spark, sf)
    kept = jobs.drop_repeats(once.unionByName(inputs.event_stream(spark, sf)))
    return zoneless(_appended(spark, kept, "stream-repeats"), "ts")


@query
def stream_silent_buckets(spark, sf):
    rolled = jobs.stream_rollup(inputs.event_stream(spark, sf))
    sensors = settle(inputs.event_readings(spark, sf).select("machine", "sensor").distinct(), "sensors")
    path = scratch_path(spark, "stream-silent")
    jobs.start_silence_watch(rolled, sensors, f"{path}/closed", f"{path}/silent", f"{path}/state").awaitTermination()
    return zoneless(spark.read.parquet(f"{path}/silent").drop("run", "batch_id"), "bucket_start")


@query
def stream_quality_report(spark, sf):
    rolled = jobs.stream_rollup(inputs.event_stream(spark, sf), inputs.event_dictionary(spark))
    rolled = rolled.withColumn("mean", round6(F.try_divide("sum_v", "n")))
    path = scratch_path(spark, "stream-report")
    jobs.start_quality_watch(rolled, inputs.event_dictionary(spark), REPORTED, f"{path}/rollup",
                             f"{path}/report", f"{path}/state").awaitTermination()
    report = spark.read.parquet(f"{path}/report")
    # The first batch holds all given files; later ones only close windows.
    newest = report.groupBy("machine", "sensor", "check", "metric").agg(
        F.max_by(F.struct("value", "status"), "batch_id").alias("m"))
    return rounded(newest.select("machine", "sensor", "check", "metric", "m.*"), "value")


@query
def describe_with_stored_bins(spark, sf):
    """Raw readings once: value bins of two loads, stored and merged as a rollup would be, bound every quartile."""
    readings, keys = inputs.line_readings(spark, sf), ["machine", "sensor"]
    loads = [settle(quantiles.value_bins(readings.where(half), keys, "value"), "value-bins") for half in ("ts < '1995-01-01'", "ts >= '1995-01-01' OR ts IS NULL")]
    stats = profile.describe(readings, "value", method="refine", bins=quantiles.merge_bins(*loads, keys=keys))
    return rounded(stats, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def stream_history_report(spark, sf):
    """The report over all closed buckets after the last batch, from merged state; the means are not rounded on their way in."""
    path = scratch_path(spark, "stream-history")
    rolled = jobs.stream_rollup(inputs.event_stream(spark, sf))
    history.start_history_watch(rolled, inputs.event_dictionary(spark), EVENTS, f"{path}/history", f"{path}/state").awaitTermination()
    return rounded(history.latest_report(spark, f"{path}/history"), "value")


@query
def rollup_folded_in_batches(spark, sf):
    """The hourly rollup from four loads, one of them sent twice and a compaction between them."""
    path, readings, known = scratch_path(spark, "folded"), inputs.event_readings(spark, sf), inputs.event_dictionary(spark)
    for load in (0, 1, 1, 2, 3):
        incremental.fold(readings.where(F.pmod("ingest_seq", F.lit(4)) == load), known, path, f"load-{load}", EVENTS.bucket)
        if load == 2:
            incremental.compact(spark, path)
    return rounded(incremental.read_folded(spark, path).drop("day"), "sum_v")


@query
def readings_without_time(spark, sf):
    """Lines without a tax count as sent without a time here: readings that no bucket can hold, per sensor."""
    lines = inputs.table(spark, sf, "lineitem")
    moment = F.when(F.col("l_tax") > 0, F.col("l_shipdate"))
    return rollup.untimed(as_readings(lines, "l_linestatus", "l_returnflag", moment, "l_quantity"))
