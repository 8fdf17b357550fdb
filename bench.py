"""Times the headline queries; prints one JSON line.

Two parts, both at $BENCH_SF_DIR on local[$BENCH_CPUS]:
  - registered queries, each from the raw tables, as the driver calls them;
  - the same measures {from raw readings, from a stored rollup} x {sorted, unsorted},
    rollup builds (batch and stream) timed on their own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = [
    "hourly_rollup", "annotate_mean", "describe_stats", "describe_raw_readings", "completeness", "duplicates",
    "duplicate_measurements", "timestamp_order", "missing_readings", "missing_intervals", "alarm_stats",
    "accuracy_of_means", "accuracy_issues", "iqr_outliers", "iqr_outliers_raw", "zscore_outliers", "anomalies",
    "correlation_blocks", "correlation_pivot", "rolling_mean", "seasonal_decompose", "histogram", "kde",
    "metadata_lint", "quality_report", "stream_rollup_equals_batch",
]


def timed(action, repeats: int = REPEATS) -> float:
    """Median seconds after one warm-up."""
    action()
    taken = []
    for _ in range(repeats):
        start = time.perf_counter()
        action()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def stored_against_raw(spark) -> dict[str, float]:
    from meterline.operators import accuracy, missing, outliers, profile, rollup
    from meterline.session import scratch_path
    from meterline.sources.tables import read_rollup, write_rollup
    from workload import inputs

    known = inputs.event_dictionary(spark)
    sources = {
        "events": (inputs.event_readings(spark, SF_DIR), inputs.EVENTS, known),
        "lineitem": (inputs.line_readings(spark, SF_DIR), inputs.LINES, None),
    }
    measures = {
        "describe": lambda r, c: profile.describe(rollup.as_series(r)),
        "missing_readings": missing.missing_readings,
        "accuracy": lambda r, c: accuracy.accuracy(rollup.as_series(r), known),
        "iqr_outliers": lambda r, c: outliers.iqr_outliers(
            rollup.as_series(r), frame=rollup.machine_frame(r, c.orig_freq_s)),
        "missing_intervals": lambda r, c: missing.missing_intervals(rollup.machine_grid(r, c.orig_freq_s), c),
    }
    seconds = {}
    for name, (readings, config, limits) in sources.items():
        for order in ("sorted", "unsorted"):
            path = scratch_path(spark, f"bench-{name}-{order}")
            by = F.col("ts") if order == "sorted" else F.xxhash64("ts", "value")
            readings.repartitionByRange(8, by).sortWithinPartitions(by).write.parquet(f"{path}/raw")
            raw = spark.read.parquet(f"{path}/raw")
            rolled = rollup.rollup(raw, limits, config.bucket)
            seconds[f"{name}.{order}.rollup_build"] = timed(lambda: write_rollup(rolled, f"{path}/rollup"))
            stored = read_rollup(spark, f"{path}/rollup")
            for measure, of in measures.items():
                if measure == "accuracy" and name != "events":
                    continue
                seconds[f"{name}.{order}.raw.{measure}"] = timed(lambda: run(of(rolled, config)))
                seconds[f"{name}.{order}.stored.{measure}"] = timed(lambda: run(of(stored, config)))
    return seconds


def hot_sensor(spark, copies: int = int(os.environ.get("BENCH_COPIES", "16"))) -> dict[str, float]:
    """lineitem *copies* times over as readings of 400 sensors, one with a third of all rows; raw and rolled up."""
    from meterline.operators import consistency, profile, rollup
    from meterline.session import settle
    from meterline.sources.tables import as_readings
    from workload import inputs

    lines = inputs.table(spark, SF_DIR, "lineitem").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    key = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "copy"), F.lit(1_000_000))
    sensor = F.when(key % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (key % 400).cast("string")))
    moment = F.timestamp_add("SECOND", key.cast("int"), F.col("l_shipdate"))
    readings = settle(as_readings(lines, F.lit("m"), sensor, moment, F.col("l_extendedprice") + key, key), "hot-readings")
    seconds = {"rows": float(readings.count())}
    seconds["rollup"] = timed(lambda: run(rollup.rollup(readings, bucket="1 hour")), 1)
    seconds["describe_refined"] = timed(lambda: run(profile.describe(readings, "value", method="refine")), 1)
    seconds["order"] = timed(lambda: run(consistency.timestamp_order(readings)), 1)
    rolled = settle(rollup.rollup(readings, bucket="1 hour"), "hot-hourly")
    seconds["describe_stored"] = timed(lambda: run(profile.describe(rollup.as_series(rolled))), 1)
    return seconds


def main() -> None:
    from meterline.session import build_session
    from workload.queries import QUERIES

    spark = build_session("meterline-bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: timed(lambda: run(QUERIES[name](spark, SF_DIR)), 1 if "stream" in name else REPEATS)
               for name in HEADLINE}
    variants = stored_against_raw(spark)
    hot = hot_sensor(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "raw_vs_stored": variants, "hot_sensor": hot, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS), "spark": spark.version, "shuffle_partitions": int(CPUS), "repeats": REPEATS}))
    spark.stop()


if __name__ == "__main__":
    main()
