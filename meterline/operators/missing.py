"""Missing raw readings and periods of missing readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import seconds_between
from meterline.schema import QualityConfig

KEYS = ["machine", "sensor"]
#: Bucket lengths of a stretch in which periods are found at once.
CHUNK = 8192


def missing_readings(rolled: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """(machine, sensor, expected, actual, missing, missing_pct, status).

    Needs no grid: an absent bucket adds nothing to the sum.  The machine's span is
    taken over the per-sensor rows, so the rollup is read once.  ``span`` mode is
    one bucket short and can go negative; an empty span gives NULLs.
    """
    machine = Window.partitionBy("machine")
    per_sensor = rolled.groupBy(*KEYS).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("actual"),
        F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"))
    span_s = seconds_between(F.min("lo").over(machine), F.max("hi").over(machine))
    if config.expected_mode == "span":
        expected = F.floor(span_s / F.lit(config.orig_freq_s))
    else:
        expected = (F.floor(span_s / F.lit(config.bucket_s)) + 1) * config.agg_freq
    expected = F.nullif(expected.cast("bigint"), F.lit(0).cast("bigint"))
    return (
        per_sensor.withColumn("expected", expected)
        .withColumn("missing", F.col("expected") - F.col("actual"))
        .withColumn("missing_pct", F.col("missing") / F.col("expected") * 100)
        .withColumn("status", F.when(F.col("expected").isNull(), "not_assessable")
                    .when(F.col("missing") > 0, "missing_readings").otherwise("ok"))
        .select(*KEYS, "expected", "actual", "missing", "missing_pct", "status")
    )


def bad_buckets(grid: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Grid cells with fewer readings than expected; NULL counts only on request."""
    short = F.col("n") < F.col("agg_freq")
    if config.null_is_gap:
        short = short | F.col("n").isNull()
    return grid.where(short)


def missing_intervals(grid: DataFrame, config: QualityConfig = QualityConfig(), chunk: int = CHUNK) -> DataFrame:
    """(machine, sensor, gap_start, gap_end, n_buckets): runs of under-filled buckets.

    Only bad cells are looked at, in stretches of *chunk* bucket lengths: the periods inside a stretch are
    final, the first and the last one may go on beyond its ends.  Only these, two a stretch, are compared along
    the sensor, so no window holds a whole sensor, however long it is or however much of it is bad.
    """
    merge_s = (F.col("freq_s") if config.gap_mode == "bucket"
               else F.col("agg_freq") * config.orig_freq_s)
    origin = F.lit("1970-01-01 00:00:00").cast(dict(grid.dtypes)["ts"])
    stretch = F.floor(seconds_between(origin, "ts") / F.lit(config.bucket_s * chunk))
    bad = bad_buckets(grid, config).select(*KEYS, "ts", merge_s.alias("merge_s"), stretch.alias("stretch"))

    inside = Window.partitionBy(*KEYS, "stretch").orderBy("ts")
    step = seconds_between(F.lag("ts").over(inside), "ts")
    periods = (
        bad.withColumn("opens", F.when(step <= F.col("merge_s"), 0).otherwise(1))
        .withColumn("island", F.sum("opens").over(inside))
        .groupBy(*KEYS, "stretch", "island")
        .agg(F.min("ts").alias("gap_start"), F.max("ts").alias("gap_end"), F.count(F.lit(1)).alias("n_buckets"), F.min_by("merge_s", "ts").alias("merge_s")))
    last = F.max("island").over(Window.partitionBy(*KEYS, "stretch"))
    inner = (F.col("island") > 1) & (F.col("island") < last)
    # An inner period is a group of its own; the outer ones of all stretches are one, in which neighbours may join.
    placed = periods.withColumn("inner", inner).withColumn("own", F.when(F.col("inner"), F.struct("stretch", "island")))
    along = Window.partitionBy(*KEYS, "own").orderBy("gap_start")
    gap = seconds_between(F.lag("gap_end").over(along), "gap_start")
    return (
        placed.withColumn("opens", F.when(gap <= F.col("merge_s"), 0).otherwise(1)).withColumn("joined", F.sum("opens").over(along))
        .groupBy(*KEYS, "own", "joined")
        .agg(F.min("gap_start").alias("gap_start"), F.max("gap_end").alias("gap_end"), F.sum("n_buckets").alias("n_buckets"))
        .drop("own", "joined"))


def gap_list(intervals: DataFrame, sensors: DataFrame) -> DataFrame:
    """(machine, sensor, gaps ARRAY<STRUCT<gap_start, gap_end>>, status), also for sensors without a gap."""
    listed = intervals.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("gap_start", "gap_end"))).alias("gaps"))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<gap_start: TIMESTAMP_NTZ, gap_end: TIMESTAMP_NTZ>>)") \
        if dict(intervals.dtypes)["gap_start"] == "timestamp_ntz" else \
        F.expr("CAST(array() AS ARRAY<STRUCT<gap_start: TIMESTAMP, gap_end: TIMESTAMP>>)")
    joined = sensors.select(*KEYS).distinct().join(listed, KEYS, "left")
    return (joined.withColumn("gaps", F.coalesce("gaps", empty))
            .withColumn("status", F.when(F.size("gaps") == 0, "no_missing_periods").otherwise("missing_periods")))
