"""Raw readings -> bucket rollup, rollup levels and the row-set grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import measure_hot, no_nan, salted_join, seconds_between, violates_limits
from meterline.operators.dictionary import limits
from meterline.schema import duration_seconds

KEYS = ("machine", "sensor")


def with_validity(readings: DataFrame, dictionary: DataFrame | None = None, measured: bool = False) -> DataFrame:
    """Clean readings plus ``is_invalid`` (outside the dictionary limits).

    The dictionary is one row per sensor: below its size threshold Catalyst broadcasts
    it, above it the salt keeps a hot sensor's readings apart: of every sensor, or with *measured*
    (batch only, starts a job) of those that a sketch finds hot, by their share.
    """
    clean = readings.withColumn("sensor", F.lower("sensor")).withColumn("value", no_nan("value"))
    if dictionary is None:
        return clean.withColumn("is_invalid", F.lit(False))
    known = limits(dictionary).select("sensor", "low_limit", "high_limit")
    hot = measure_hot(clean, ["sensor"]) if measured else None
    return (salted_join(clean, known, ["sensor"], "ts", how="left", hot=hot)
            .withColumn("is_invalid", violates_limits("value"))
            .drop("low_limit", "high_limit"))


def rollup_measures(extremes: bool = False) -> list:
    """Mergeable aggregates of one bucket."""
    value = F.col("value")
    measures = [
        F.count(value).alias("n"),
        F.sum(value).alias("sum_v"),
        F.count_if(value.isNotNull() & ~F.col("is_invalid")).alias("n_valid"),
        F.count_if(F.col("is_invalid")).alias("n_invalid"),
    ]
    if extremes:
        measures += [F.min(value).alias("min_v"), F.max(value).alias("max_v")]
    return measures


def rollup(readings: DataFrame, dictionary: DataFrame | None = None, bucket: str = "1 hour",
           extremes: bool = False, measured: bool = False) -> DataFrame:
    """(machine, sensor, bucket_start, n, sum_v, n_valid, n_invalid[, min_v, max_v]).

    The only operator that must read all raw rows.  Partial sums combine before
    the shuffle, and the shuffle key holds the bucket, so a hot sensor spreads
    over as many keys as it has buckets.  A reading without a timestamp has no
    bucket: ``untimed`` counts those.  *measured* as for ``with_validity``.
    """
    return (
        with_validity(readings, dictionary, measured)
        .groupBy(*KEYS, F.window("ts", bucket).alias("w"))
        .agg(*rollup_measures(extremes))
        .select(*KEYS, F.col("w.start").alias("bucket_start"), *[
            c for c in ("n", "sum_v", "n_valid", "n_invalid", "min_v", "max_v")
            if extremes or c not in ("min_v", "max_v")])
    )


def untimed(readings: DataFrame) -> DataFrame:
    """(machine, sensor, rows, untimed, status): readings and those of them that no bucket can hold, as they have no timestamp."""
    counted = readings.withColumn("sensor", F.lower("sensor")).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts").isNull()).alias("untimed"))
    return counted.withColumn("status", F.when(F.col("untimed") > 0, "untimed_readings").otherwise("ok"))


def merge_rollup(rolled: DataFrame, bucket: str) -> DataFrame:
    """Coarser rollup (hour -> day) from a finer one; raw rows are not read again."""
    measures = [F.sum(c).alias(c) for c in ("n", "sum_v", "n_valid", "n_invalid")]
    if "min_v" in rolled.columns:
        measures += [F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v")]
    kept = [m for m in rolled.columns if m not in (*KEYS, "bucket_start")]
    return (rolled.groupBy(*KEYS, F.window("bucket_start", bucket).alias("w"))
            .agg(*measures).select(*KEYS, F.col("w.start").alias("bucket_start"), *kept))


def apply_aggregation_rule(rolled: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``agg_value``: min, max or mean of the bucket, as the dictionary asks."""
    rules = limits(dictionary).select("sensor", "aggregation_rule")
    mean = F.try_divide("sum_v", "n")
    return rolled.join(rules, "sensor", "left").withColumn(
        "agg_value",
        F.when(F.col("aggregation_rule") == "min", F.col("min_v"))
        .when(F.col("aggregation_rule") == "max", F.col("max_v")).otherwise(mean))


def with_mean(rolled: DataFrame) -> DataFrame:
    return rolled if "mean" in rolled.columns else rolled.withColumn("mean", F.try_divide("sum_v", "n"))


def annotate(rolled: DataFrame) -> DataFrame:
    """(machine, sensor, ts, mean, alarms) of a rollup or a grid."""
    return as_series(rolled).select(*KEYS, "ts", "mean", F.col("n_invalid").alias("alarms"))


def ticks(rolled: DataFrame) -> DataFrame:
    """The machine's row set: distinct (machine, ts) with a dense 0-based ``idx``.

    One row per bucket and machine, so the window below holds at most the number
    of buckets in the time range, whatever the number of readings.
    """
    order = Window.partitionBy("machine").orderBy("ts")
    return (rolled.select("machine", F.col("bucket_start").alias("ts")).distinct()
            .withColumn("idx", F.row_number().over(order) - 1))


def calendar_ticks(rolled: DataFrame, bucket: str) -> DataFrame:
    """Every bucket between the machine's first and last one, present or not.

    First the starts of runs of buckets are listed, then the buckets of each: however early a stray
    timestamp lies, no row holds an array longer than the square root of the span, in buckets, asks for.
    """
    step = duration_seconds(bucket)
    span = rolled.groupBy("machine").agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"))
    last = F.floor(seconds_between("lo", "hi") / step).cast("bigint")
    run = F.ceil(F.sqrt(last + 1)).cast("bigint")
    runs = span.withColumn("last", last).withColumn("run", run).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"), F.col("run"))).alias("first"))
    cells = runs.select("machine", "lo", F.explode(F.sequence("first", F.least(F.col("first") + F.col("run") - 1, F.col("last")))).alias("idx"))
    # Whole hours and the seconds beyond them: seconds alone outgrow an int after 68 years.
    past = F.col("idx") * step
    hours, rest = F.call_function("div", past, F.lit(3600).cast("bigint")).cast("int"), (past % 3600).cast("int")
    return cells.select("machine", F.timestamp_add("SECOND", rest, F.timestamp_add("HOUR", hours, F.col("lo"))).alias("ts"), F.col("idx").cast("int").alias("idx"))


def tick_frequency(tick_rows: DataFrame, orig_freq_s: int = 10) -> DataFrame:
    """(machine, rows, freq_s, agg_freq): ticks, their commonest step (smallest on ties, NULL
    for a single tick) and the readings expected per bucket."""
    order = Window.partitionBy("machine").orderBy("ts")
    return (tick_rows.withColumn("step", seconds_between(F.lag("ts").over(order), "ts"))
            .groupBy("machine").agg(F.count(F.lit(1)).alias("rows"), F.mode("step", True).alias("freq_s"))
            .withColumn("agg_freq", F.expr(f"freq_s div {int(orig_freq_s)}")))


def machine_frame(rolled: DataFrame, orig_freq_s: int = 10) -> DataFrame:
    """One row per machine of a rollup: see ``tick_frequency``."""
    return tick_frequency(ticks(rolled), orig_freq_s)


def as_series(rolled: DataFrame) -> DataFrame:
    """A rollup as a sparse series: ``ts`` and ``mean`` next to the measures."""
    return with_mean(rolled).withColumnRenamed("bucket_start", "ts")


_MEASURE_DEFAULTS = {"n": 0, "n_valid": 0, "n_invalid": 0}
_GRID_CHUNK = 1024


def _fill_grid(rolled: DataFrame, tick_rows: DataFrame, orig_freq_s: int) -> DataFrame:
    """tick_rows x the machine's sensors, left-joined to the rollup.

    Ticks and sensors meet on (machine, run of ticks), not on the machine alone:
    a machine with most of the cells is then built by many tasks.
    """
    frame = tick_frequency(tick_rows, orig_freq_s).drop("rows")
    tick_rows = (tick_rows.join(frame, "machine")
                 .withColumn("run", F.expr(f"idx div {_GRID_CHUNK}")))
    runs = tick_rows.select("machine", "run").distinct()
    sensors = rolled.select(*KEYS).distinct().join(runs, "machine")
    cells = tick_rows.join(sensors, ["machine", "run"]).drop("run")
    measured = rolled.withColumnRenamed("bucket_start", "ts").withColumn("_present", F.lit(True))
    filled = cells.join(measured, [*KEYS, "ts"], "left")
    # Only cells the grid added get zero counts; a stored NULL count stays NULL.
    for name, default in _MEASURE_DEFAULTS.items():
        filled = filled.withColumn(
            name, F.when(F.col("_present").isNull(), F.lit(default).cast("bigint")).otherwise(F.col(name)))
    return with_mean(filled.drop("_present"))


def machine_grid(rolled: DataFrame, orig_freq_s: int = 10) -> DataFrame:
    """One row per sensor for every bucket its machine has.

    (machine, sensor, ts, idx, freq_s, agg_freq, n, sum_v, n_valid, n_invalid, mean);
    cells without a reading have n = 0 and a NULL mean.  *rolled* is read by
    several branches, so pass a stored rollup.
    """
    return _fill_grid(rolled, ticks(rolled), orig_freq_s)


def calendar_grid(rolled: DataFrame, bucket: str = "1 hour", orig_freq_s: int = 10) -> DataFrame:
    """Like ``machine_grid`` but also with the hours the whole machine is silent."""
    return _fill_grid(rolled, calendar_ticks(rolled, bucket), orig_freq_s)
