import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterline.functions import joins, measure_hot, salted_join
from meterline.operators import dictionary, invalid, reshape, rollup
from meterline.schema import QualityConfig, duration_seconds
from meterline.session import scratch_path
from meterline.sources import incremental
from tests.conftest import SF, at, found
from workload import inputs

READING = "machine string, sensor string, ts timestamp_ntz, value double, ingest_seq long"
WIDE = ("timestamp timestamp_ntz, sum_col32ti448 double, count_col32ti448 bigint, count_col32ti448_isvalid bigint, "
        "sum_col32ti448_2 double, count_col32ti448_2 bigint, count_col32ti448_2_isvalid bigint, sum_cocol1 double")


def test_config():
    assert duration_seconds("30 minutes") == 1800
    assert QualityConfig(orig_freq_s=7).agg_freq == 514
    with pytest.raises(ValueError):
        QualityConfig(gap_mode="other")


def test_rollup_counts_nulls_nans_and_limits(rows):
    readings = rows(READING, ("m", "A", at(0), 1.0, 1), ("m", "a", at(.5), 9.0, 2), ("m", "a", at(.6), None, 3),
                    ("m", "a", at(.7), float("nan"), 4), ("m", "b", at(1), 5.0, 5))
    known = rows("tag string, tag_description string, machine_group string, low_threshold string, "
                 "high_threshold string, threshold_type string, aggregation_rule string",
                 ("A", "d", "g", None, "5", "Up", "max"))
    got = rollup.rollup(readings, known, extremes=True)
    assert found(got, "sensor", "bucket_start", "n", "sum_v", "n_valid", "n_invalid", "min_v", "max_v") == [
        ("a", at(0), 2, 10.0, 1, 1, 1.0, 9.0), ("b", at(1), 1, 5.0, 1, 0, 5.0, 5.0)]
    ruled = rollup.apply_aggregation_rule(got, known)
    assert found(ruled, "sensor", "agg_value") == [("a", 9.0), ("b", 5.0)]


def test_merged_rollup_equals_direct(spark):
    readings = inputs.event_readings(spark, SF)
    direct = rollup.rollup(readings, bucket="1 day").withColumn("sum_v", F.round("sum_v", 6))
    merged = rollup.merge_rollup(rollup.rollup(readings), "1 day").withColumn("sum_v", F.round("sum_v", 6))
    assert direct.exceptAll(merged).isEmpty() and merged.exceptAll(direct).isEmpty()
    assert rollup.rollup(readings).agg(F.sum("n")).first()[0] == readings.count()


def test_known_shape_of_events(spark):
    one = inputs.event_readings(spark, "/root/testdata/sf0.01").withColumn("machine", F.lit("m"))
    assert rollup.rollup(one).count() == 3385


def test_sensor_columns_keep_the_full_suffix(rows):
    wide = rows(WIDE, (at(0), 6.0, 2, 1, 0.0, 0, 0, 4.0))
    assert reshape.sensor_columns(wide) == {
        "32ti448": "col32ti448", "32ti448_2": "col32ti448_2", "cocol1": "cocol1"}
    long = reshape.wide_to_long(wide, "m")
    assert found(long, "sensor", "n", "sum_v", "n_valid", "n_invalid") == [
        ("32ti448", 2, 6.0, 1, 1), ("32ti448_2", 0, 0.0, 0, 0), ("cocol1", None, 4.0, None, None)]
    assert found(rollup.annotate(long), "sensor", "mean", "alarms") == [
        ("32ti448", 3.0, 1), ("32ti448_2", None, 0), ("cocol1", None, None)]
    with pytest.raises(ValueError, match="same sensor"):
        reshape.sensor_columns(rows("sum_colabc double, sum_abc double", (1.0, 2.0)))
    valid = reshape.wide_to_long(wide, "m", flag_meaning="valid")
    assert found(valid.where("sensor = '32ti448'"), "n_valid", "n_invalid") == [(1, 1)]


def test_wide_round_trip(rows):
    long = rows("machine string, sensor string, bucket_start timestamp_ntz, n bigint, sum_v double, n_valid bigint, "
                "n_invalid bigint", ("m", "a_1", at(0), 2, 3.0, 1, 1), ("m", "b", at(0), 1, 1.0, 1, 0))
    wide = reshape.rollup_to_wide(long)
    assert wide.columns == ["machine", "timestamp", "sum_cola_1", "count_cola_1", "count_cola_1_isvalid",
                            "sum_colb", "count_colb", "count_colb_isvalid"]
    back = reshape.wide_to_long(wide, F.col("machine"))
    assert back.exceptAll(long).isEmpty() and long.exceptAll(back).isEmpty()
    export = reshape.annotated_to_wide(rollup.annotate(long), ["a_1", "b"])
    assert export.columns == ["machine", "ts", "a_1", "a_1_alarms", "b", "b_alarms"]
    assert export.first()["a_1"] == 1.5


def test_grids(rows):
    long = rows("machine string, sensor string, bucket_start timestamp_ntz, n bigint, sum_v double, n_valid bigint, "
                "n_invalid bigint", ("m", "a", at(0), 2, 3.0, 2, 0), ("m", "b", at(1), 1, 1.0, 1, 0),
                ("m", "a", at(3), 1, 4.0, 1, 0), ("k", "z", at(9), 1, 4.0, 1, 0))
    grid = rollup.machine_grid(long, 1800)
    assert found(grid.where("machine = 'm'"), "sensor", "ts", "idx", "n", "mean") == [
        ("a", at(0), 0, 2, 1.5), ("a", at(1), 1, 0, None), ("a", at(3), 2, 1, 4.0),
        ("b", at(0), 0, 0, None), ("b", at(1), 1, 1, 1.0), ("b", at(3), 2, 0, None)]
    # one tick only: the frequency is unknown, not an error
    assert found(grid.where("machine = 'k'"), "freq_s", "agg_freq") == [(None, None)]
    full = rollup.calendar_grid(long, "1 hour", 1800).where("machine = 'm'")
    assert full.count() == 8 and found(full.where("sensor = 'a' and n = 0"), "ts") == [(at(1),), (at(2),)]


def test_grid_keeps_a_stored_null_count(rows):
    long = rows("machine string, sensor string, bucket_start timestamp_ntz, n bigint, sum_v double, n_valid bigint, "
                "n_invalid bigint", ("m", "a", at(0), None, 3.0, None, None), ("m", "a", at(1), 1, 3.0, 1, 0))
    assert found(rollup.machine_grid(long, 10), "ts", "n") == [(at(0), None), (at(1), 1)]


def test_select_combine_and_buckets(rows):
    means = rows("machine string, sensor string, ts timestamp_ntz, mean double", ("m", "a", at(0), 1.0))
    alarms = rows("machine string, sensor string, ts timestamp_ntz, alarms bigint", ("m", "a", at(0), 2), ("m", "b", at(0), 1))
    both = reshape.combine_means_and_alarms(means, alarms)
    assert found(both, "sensor", "mean", "alarms") == [("a", 1.0, 2), ("b", None, 1)]
    assert found(reshape.select_sensors(both, ["A"]), "sensor") == [("a",)]
    assert found(invalid.at_buckets(alarms, means), "sensor", "mean") == [("a", 1.0)]


TAG = ("tag string, tag_description string, machine_group string, low_threshold string, high_threshold string, "
       "threshold_type string, aggregation_rule string, engineering_units string, category string")


def tags(rows):
    return rows(
        TAG, ("P1", "PUMP ", "K-1_KT-1", "1,799,999,952,316,280", None, "Down", "min", "kg/cm2", "Pressure"),
        ("p2", "PUMP", "K-1_KT-1", None, "5", "Up", "max", "Kgf/cm2", None),
        ("p3", "PUMP", "K-2", "9", "5", "Up/Down", "avg", "kg/cm2", None),
        ("p4", None, "K-2", None, None, None, "avg", None, None), ("P4", None, "K-2", "1", None, "Up", "avg", None, None))


def test_dictionary_limits_and_filters(rows):
    known = tags(rows)
    assert found(dictionary.limits(known), "sensor", "low_limit", "high_limit") == [
        ("p1", None, None), ("p2", None, 5.0), ("p3", 9.0, 5.0), ("p4", None, None)]
    assert found(dictionary.machine_tags(known, "K-2"), "tag") == [("P4",), ("p3",), ("p4",)]
    assert found(dictionary.machine_tags(known, "k-1_KT-1", contains=True), "tag") == [("P1",), ("p2",)]
    assert found(dictionary.sensors_per_group(known), "machine_group", "sensors") == [("K-1_KT-1", 2), ("K-2", 3)]
    assert found(dictionary.machine_groups(known), "machine_group") == [("K-1_KT-1",), ("K-2",)]
    sensors = rows("sensor string", ("P1",), ("x",))
    assert found(dictionary.present_tags(known, sensors), "tag") == [("p1",)]
    assert found(dictionary.labels(rows("sensor string", ("p2",), ("p4",), ("x",)), known), "label") == [
        ("PUMP (p2)",), ("p4",), ("x",)]
    assert found(dictionary.unmatched_sensors(sensors, known), "sensor", "issue") == [
        ("p2", "no_data"), ("p3", "no_data"), ("p4", "no_data"), ("x", "no_metadata")]


def test_metadata_lint(rows):
    assert found(dictionary.metadata_lint(tags(rows)), "sensor", "issue") == [
        ("p1", "threshold_malformed"), ("p1", "untrimmed_text"), ("p2", "unit_spelling"),
        ("p3", "low_above_high"), ("p4", "duplicate_tag"), ("p4", "high_threshold_missing"), ("p4", "not_assessed")]


def test_calendar_spans_more_than_a_century(rows):
    data = rows(ROLLUP, ("m", "a", datetime(1901, 1, 1), 1, 1.0, 1, 0), ("m", "a", datetime(2024, 5, 1, 3), 1, 1.0, 1, 0))
    got = rollup.calendar_ticks(data, "1 hour")
    last = got.orderBy(F.desc("idx")).first()
    hours = int((datetime(2024, 5, 1, 3) - datetime(1901, 1, 1)).total_seconds() // 3600)
    assert (got.count(), last.idx, last.ts) == (hours + 1, hours, datetime(2024, 5, 1, 3))
    odd = rollup.calendar_ticks(rows(ROLLUP, ("m", "a", datetime(2024, 1, 1), 1, 1.0, 1, 0), ("m", "a", datetime(2024, 1, 1, 2, 30), 1, 1.0, 1, 0)), "90 minutes")
    assert found(odd, "idx", "ts") == [(0, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1, 1, 30))]


def test_readings_without_a_time_are_counted(rows):
    data = rows("machine string, sensor string, ts timestamp_ntz, value double", ("m", "A", None, 1.0), ("m", "a", at(0), 2.0), ("m", "b", at(0), 3.0))
    assert found(rollup.untimed(data), "sensor", "rows", "untimed", "status") == [("a", 2, 1, "untimed_readings"), ("b", 1, 0, "ok")]
    assert rollup.untimed(data.limit(0)).collect() == []


ROLLUP = ("machine string, sensor string, bucket_start timestamp_ntz, n bigint, sum_v double, n_valid bigint, "
          "n_invalid bigint")
MEASURES = ["machine", "sensor", "bucket_start", "n", "sum_v", "n_valid", "n_invalid"]


def test_folds_equal_one_rebuild_and_repeats_change_nothing(spark, rows, monkeypatch):
    path, rng = scratch_path(spark, "folds"), random.Random(3)
    data = [[(rng.choice(["01", "m"]), rng.choice("abc"), at(rng.random() * 60), float(rng.randint(0, 9)), i) for i in range(200)] + [("m", "a", None, 1.0, 0)] for _ in range(4)]
    loads = [rows(READING, *own) for own in data]
    whole = lambda k: found(rollup.rollup(rows(READING, *[r for own in data[:k] for r in own])), *MEASURES)
    now = lambda: found(incremental.read_folded(spark, path), *MEASURES)
    assert incremental.record(spark, path).collect() == []
    assert incremental.fold(loads[0], None, path, "one") and incremental.fold(loads[1], None, path, "two")
    assert now() == whole(2)
    assert not incremental.fold(loads[1], None, path, "two") and now() == whole(2)
    # A fold that dies before its record leaves nothing that counts, and is repeated.
    with monkeypatch.context() as m:
        m.setattr(incremental, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.fold(loads[2], None, path, "three")
        with pytest.raises(RuntimeError):
            incremental.compact(spark, path)
    assert now() == whole(2)
    incremental.compact(spark, path)
    assert now() == whole(2) and [p for p in os.listdir(f"{path}/data") if p.startswith("part=")] == ["part=c-3"]
    assert incremental.fold(loads[2], None, path, "three") and not incremental.fold(loads[0], None, path, "one")
    assert incremental.fold(loads[3].limit(0), None, path, "empty")
    assert now() == whole(3)
    assert found(incremental.record(spark, path), "batch", "readings", "untimed") == [("empty", 0, 0), ("one", 201, 1), ("three", 201, 1), ("two", 201, 1)]
    plan = incremental.read_folded(spark, path).where("day = DATE '2024-01-02' AND machine = 'm'")._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    with pytest.raises(ValueError):
        incremental.fold(loads[0], None, path, "../x")


def test_measured_salts_spread_hot_keys_only(spark):
    """Half the rows have one key: it alone is spread, by its share, and results stay those of a plain join."""
    spread = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 10 = 1 THEN 'warm' WHEN id = 3 THEN NULL ELSE 's' || id END AS sensor", "id AS ts")
    hot = measure_hot(spread, ["sensor"], parts=16)
    by_hash = {r.h: r.sensor for r in spread.select("sensor", F.xxhash64("sensor").alias("h")).distinct().collect()}
    assert {by_hash[h]: n for h, n in hot.items()} == {"hot": 8, "warm": 2}
    limits = spread.where("sensor IS NOT NULL").select("sensor").distinct().withColumn("top", F.length("sensor"))
    for how in ("inner", "left"):
        got = salted_join(spread, limits.where("sensor <> 's7'"), ["sensor"], "ts", how=how, hot=hot)
        plain = spread.join(limits.where("sensor <> 's7'"), ["sensor"], how)
        assert sorted(got.select("ts", "sensor", "top").collect(), key=str) == sorted(plain.select("ts", "sensor", "top").collect(), key=str)
    salted = spread.where("sensor = 'hot'").select(F.pmod(F.xxhash64("ts"), joins._salts_of(hot, ["sensor"])).alias("salt")).groupBy("salt").count()
    assert max(r["count"] for r in salted.collect()) < 4000 / 16 * 1.3
    copies = limits.withColumn("n", joins._salts_of(hot, ["sensor"])).agg(F.sum("n"), F.count("n")).first()
    assert copies[0] == copies[1] + 7 + 1
    assert measure_hot(spread.limit(0), ["sensor"]) == {} and measure_hot(limits, ["sensor"], parts=16) == {}
    assert salted_join(spread, limits, ["sensor"], "ts", hot={}).count() == 3999
    with pytest.raises(ValueError):
        salted_join(spread.withColumn("sensor", F.col("ts").cast("int")), spread.select(F.col("ts").alias("sensor")), ["sensor"], "ts", hot={1: 2})
