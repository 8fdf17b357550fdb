import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import accuracy, consistency, invalid, missing, outliers, profile, rollup
from meterline.operators.quantiles import exact_quantiles
from meterline.schema import QualityConfig
from tests.conftest import at, found
from workload import inputs

ROLLUP = ("machine string, sensor string, bucket_start timestamp_ntz, n bigint, sum_v double, n_valid bigint, "
          "n_invalid bigint")
SERIES = "machine string, sensor string, ts timestamp_ntz, mean double"


def series(rows, values, sensor="a"):
    return rows(SERIES, *[("m", sensor, at(i), v) for i, v in enumerate(values)])


def test_frequency_and_missing_readings(rows):
    counts = rows(ROLLUP, *[("m", "a", at(h), n, 0.0, n, 0) for h, n in ((0, 360), (1, 300), (2, 360), (4, 0))])
    assert found(consistency.infer_frequency(rollup.ticks(counts)), "freq_s", "agg_freq", "status") == [(3600, 360, "ok")]
    assert found(consistency.time_steps(rollup.ticks(counts)), "step_s") == [(3600,), (3600,), (7200,)]
    (expected, lost, pct), = found(missing.missing_readings(counts), "expected", "missing", "missing_pct")
    assert (expected, lost) == (1440, 420) and pct == pytest.approx(29.1667, abs=1e-4)
    gaps = missing.missing_intervals(rollup.machine_grid(counts))
    assert found(gaps, "gap_start", "gap_end", "n_buckets") == [(at(1), at(1), 1), (at(4), at(4), 1)]
    listed = missing.gap_list(gaps, rows("machine string, sensor string", ("m", "a"), ("m", "b")))
    assert [(s, len(g), t) for s, g, t in found(listed, "sensor", "gaps", "status")] == [
        ("a", 2, "missing_periods"), ("b", 0, "no_missing_periods")]


def test_expected_modes(rows):
    counts = rows(ROLLUP, *[("m", "a", at(h), 360, 0.0, 360, 0) for h in range(3)])
    assert found(missing.missing_readings(counts), "expected", "missing", "missing_pct") == [(720, -360, -50.0)]
    whole = QualityConfig(expected_mode="buckets")
    assert found(missing.missing_readings(counts, whole), "expected", "missing", "missing_pct") == [(1080, 0, 0.0)]
    single = counts.where(F.col("bucket_start") == F.lit(at(0)).cast("timestamp_ntz"))
    assert found(missing.missing_readings(single), "expected", "missing", "status") == [(None, None, "not_assessable")]
    assert found(consistency.infer_frequency(rollup.ticks(single)), "freq_s", "status") == [(None, "not_assessable")]


def test_gap_modes_with_a_frequency_that_does_not_divide(rows):
    counts = rows(ROLLUP, *[("m", "a", at(h), n, 0.0, n, 0) for h, n in ((0, 514), (1, 5), (2, 6), (3, 514))])
    grid = rollup.machine_grid(counts, 7)
    assert found(grid, "agg_freq")[0] == (514,)
    assert missing.missing_intervals(grid, QualityConfig(orig_freq_s=7)).count() == 1
    assert missing.missing_intervals(grid, QualityConfig(orig_freq_s=7, gap_mode="product")).count() == 2


def test_null_counts_are_gaps_only_on_request(rows):
    counts = rows(ROLLUP, ("m", "a", at(0), 360, 0.0, 360, 0), ("m", "a", at(1), None, 0.0, None, None))
    grid = rollup.machine_grid(counts)
    assert missing.missing_intervals(grid).count() == 0
    assert missing.missing_intervals(grid, QualityConfig(null_is_gap=True)).count() == 1


def test_islands_cover_the_bad_buckets_exactly(spark):
    one = inputs.event_readings(spark, "/root/testdata/sf0.01").withColumn("machine", F.lit("m"))
    counts = rollup.rollup(one)
    # Without grid cells, as a stream sees them: 508 runs.
    present = rollup.ticks(counts).join(counts.withColumnRenamed("bucket_start", "ts"), ["machine", "ts"]) \
        .withColumn("freq_s", F.lit(3600)).withColumn("agg_freq", F.lit(2))
    assert missing.missing_intervals(present, inputs.EVENTS).count() == 508
    grid = rollup.machine_grid(counts, 1800)
    bad = missing.bad_buckets(grid, inputs.EVENTS)
    islands = missing.missing_intervals(grid, inputs.EVENTS)
    assert islands.agg(F.sum("n_buckets")).first()[0] == bad.count()
    outside = bad.join(islands, ["machine", "sensor"]).where("ts between gap_start and gap_end").groupBy(
        "machine", "sensor", "ts").count()
    assert outside.count() == bad.count() and outside.where("count > 1").isEmpty()


def test_describe_and_iqr(rows):
    data = series(rows, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    got = found(profile.describe(data), "n", "mean", "std", "min", "p25", "p50", "p75", "max")[0]
    assert got == (5, 22.0, pytest.approx(43.617657), 1.0, 2.0, 3.0, 4.0, 100.0)
    assert found(outliers.iqr_outliers(data), "outlier_pct")[0][0] == pytest.approx(16.6667, abs=1e-4)
    # the sparse form needs the machine's ticks for the same denominator
    sparse = data.where("mean is not null")
    frame = rows("machine string, rows bigint", ("m", 6))
    both = found(outliers.missing_and_outliers(sparse, frame=frame), "missing_pct", "outlier_pct")[0]
    assert both == (pytest.approx(16.6667, abs=1e-4), pytest.approx(16.6667, abs=1e-4))


def test_profile_of_grid_and_sparse_form_agree(spark, rows):
    counts = rollup.rollup(inputs.event_readings(spark, "/root/testdata/sf0.001")).cache()
    grid, sparse = rollup.machine_grid(counts, 1800), rollup.as_series(counts)
    frame = rollup.machine_frame(counts, 1800)
    for check in (profile.general_info, profile.missing_share, profile.completeness):
        def rounded(df):
            return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found(df, *df.columns)]
        assert rounded(check(grid)) == rounded(check(sparse, frame=frame))


def test_completeness(rows):
    data = series(rows, [1.0, None, 3.0, 4.0]).unionByName(series(rows, [1.0] * 4, "b"))
    assert found(profile.completeness(data), "sensor", "complete_pct", "overall_pct", "below_threshold") == [
        ("a", 75.0, 87.5, True), ("b", 100.0, 87.5, False)]
    assert found(profile.general_info(data), "total_points", "missing", "sensors", "missing_pct") == [(8, 1, 2, 12.5)]
    assert found(profile.points_per_sensor(data), "sensor", "points") == [("a", 3), ("b", 4)]


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0] * 7, [1.0, 2.0, 3.0, 4.0, 1e12], [-1e9, -3.5, 0.0, 0.0, 1e-7, 2e-7, 8.0],
    [float(i * i % 97) / 7 for i in range(500)], [0.0] * 400 + [float(i) for i in range(100)]])
@pytest.mark.parametrize("gather", [1, 1_000_000])
def test_refined_quantiles_equal_the_builtin(rows, values, gather):
    data = series(rows, values)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    exact = found(exact_quantiles(data, ["machine"], "mean", probs), "quantiles")[0][0]
    refined = found(exact_quantiles(data, ["machine"], "mean", probs, method="refine", gather=gather), "quantiles")[0][0]
    assert refined == pytest.approx(exact, rel=1e-12)


def test_refined_quantiles_with_infinities_and_a_hot_key(rows, monkeypatch):
    from meterline.operators import quantiles

    levels = []
    narrow = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a, **k: levels.append(1) or narrow(*a, **k))
    hot = [float("-inf"), float("inf"), 1.7e308, -1.7e308, *[1.0 + i * 1e-12 for i in range(600)], *[3.0] * 300]
    data = series(rows, hot).unionByName(series(rows, [1.0, 2.0], "b"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for gather, most in ((1_000_000, 0), (5, 8)):
        levels.clear()
        got = exact_quantiles(data, ["machine", "sensor"], "mean", probs, method="refine", gather=gather)
        found_ = dict(found(got, "sensor", "quantiles"))
        ordered = sorted(hot)
        expected = [ordered[0], *[ordered[int(p * (len(hot) - 1))] for p in probs[1:-1]], ordered[-1]]
        assert found_["a"] == pytest.approx(expected, rel=1e-9) and found_["b"] == [1.0, 1.25, 1.5, 1.75, 2.0]
        assert (gather < 10) <= len(levels) <= most


def test_stored_bins_merge_and_leave_one_scan(rows, monkeypatch):
    from meterline.operators import quantiles

    rng = random.Random(9)
    values = [rng.choice([rng.gauss(1000, 30), rng.gauss(-5, 1), 1e9, 0.0]) for _ in range(900)]
    parts = [series(rows, values[i::3]).unionByName(series(rows, [None, 4.0], "b")).unionByName(series(rows, [None], "c")) for i in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = ["machine", "sensor"]
    stored = quantiles.merge_bins(*[quantiles.value_bins(p, keys, "mean") for p in parts], keys=keys)
    monkeypatch.setattr(quantiles, "_narrowed", None)  # no scan but the counting one
    monkeypatch.setattr(profile, "value_bins", None)
    columns = ["sensor", "n", "mean", "std", "min", "p25", "p50", "p75", "max"]
    got = found(profile.describe(whole, method="refine", bins=stored), *columns)
    expected = found(profile.describe(whole), *columns)
    assert [r[:2] for r in got] == [r[:2] for r in expected] and got[2] == ("c", 0, *[None] * 7)
    for g, e in zip(got[:2], expected[:2]):
        assert g[2:] == pytest.approx(e[2:], rel=1e-12)


def test_refined_quantiles_by_key(rows):
    data = series(rows, [1.0, 5.0, 2.0, 8.0], "a").unionByName(series(rows, [None, 3.0], "b")).unionByName(
        series(rows, [None], "c"))
    got = exact_quantiles(data, ["machine", "sensor"], "mean", [0.5, 0.25], method="refine", gather=2)
    assert found(got, "sensor", "quantiles") == [("a", [3.5, 1.75]), ("b", [3.0, 3.0])]


def test_duplicates(rows):
    table = rows("a int, b int", (1, 5), (1, 5), (1, 5), (2, 6))
    assert found(consistency.duplicate_records(table, ["a", "b"]), "dup_rows", "dup_half", "dup_extra", "dup_pct") == [
        (3, 1.5, 2, 37.5)]
    nulls = rows("a int, b int", (None, 5), (None, 5))
    assert found(consistency.duplicate_records(nulls, ["a", "b"]), "dup_rows") == [(2,)]
    empty = table.where("a > 9")
    assert found(consistency.duplicate_records(empty, ["a"]), "total_rows", "dup_pct") == [(0, None)]


def test_duplicate_ticks_sparse_and_full(rows):
    full = rows(SERIES, ("m", "a", at(0), 1.0), ("m", "b", at(0), None), ("m", "a", at(1), 1.0), ("m", "b", at(1), None),
                ("m", "a", at(2), None), ("m", "b", at(2), 1.0), ("m", "a", at(3), None), ("m", "b", at(3), None),
                ("m", "a", at(4), None), ("m", "b", at(4), None), ("m", "a", at(5), -0.0), ("m", "b", at(5), 2.0),
                ("m", "a", at(6), 0.0), ("m", "b", at(6), 2.0))
    expected = [(7, 6, 3.0, 3)]
    assert found(consistency.duplicate_ticks(full), "total_rows", "dup_rows", "dup_half", "dup_extra") == expected
    sparse = full.where("mean is not null")
    assert found(consistency.duplicate_ticks(sparse), "total_rows", "dup_rows") == [(5, 4)]


@pytest.mark.parametrize("hours,expected", [
    ((0, 0, 1), (0, 1, True)), ((0, 2, 1), (1, 0, False)), ((0, 2, 1, 1, 5, 4), (2, 1, False))])
def test_timestamp_order(rows, hours, expected):
    readings = rows("machine string, ts timestamp_ntz, ingest_seq long", *[("m", at(h), i) for i, h in enumerate(hours)])
    got = consistency.timestamp_order(readings.repartition(3))
    assert found(got, "n_backward", "n_equal", "monotonic") == [expected]


def test_order_without_numbers_is_not_assessable(rows):
    readings = rows("machine string, ts timestamp_ntz, ingest_seq long", ("m", at(0), 1), ("m", at(1), None), ("n", at(5), 1), ("n", None, 2), ("n", at(4), 3))
    got = found(consistency.timestamp_order(readings), "machine", "total_rows", "n_backward", "status")
    assert got == [("m", 2, None, "not_assessable"), ("n", 3, 1, "out_of_order")]


ORDERED = "machine string, ts timestamp_ntz, ingest_seq long"


def plain_order(rows):
    """Counts of (machine, ts) rows in the order they come."""
    out, last = {}, {}
    for machine, ts in rows:
        own = out.setdefault(machine, [0, 0, 0])
        own[0] += 1
        if ts is not None:
            if machine in last:
                own[1] += ts < last[machine]
                own[2] += ts == last[machine]
            last[machine] = ts
    return sorted(((m, *c) for m, c in out.items()), key=repr)


def order_counts(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_stored_order_over_files_and_splits(spark, rows, tmp_path):
    rng = random.Random(8)
    data = [(rng.choice(["m", "n", None, "hot", "hot"]), rng.choice([None, at(rng.randint(0, 40))]) if rng.random() < 0.1 else at(rng.randint(0, 40)), None) for _ in range(4000)]
    # Three files, whose rows lie in many row groups, read in small splits: runs are compared at every seam.
    for i in range(3):
        part = data[i * 1300:(i + 1) * 1300] if i < 2 else data[2600:]
        rows(ORDERED, *part).coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.size", 512).mode("append").parquet(f"{tmp_path}/{i}")
    expected = plain_order([(m, t) for m, t, _ in data])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            table = consistency.with_stored_order(spark.read.parquet(*[f"{tmp_path}/{i}" for i in range(3)]))
            stored = consistency.timestamp_order(table, by="stored")
            assert order_counts(stored) == expected
            plan = stored._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and plan.index("Exchange") < plan.index("MapInArrow")  # nothing is dealt before the runs
        # Without numbers the order by number falls back on the files.
        assert order_counts(consistency.timestamp_order(table)) == expected
        with pytest.raises(ValueError):
            consistency.timestamp_order(spark.read.parquet(f"{tmp_path}/0"), by="stored")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_repeated_and_dense_numbers_are_cut_by_rows(rows, span):
    rng = random.Random(span)
    data = [(rng.choice(["hot", "hot", "hot", "m"]), at(rng.randint(0, 300) / 7), rng.randrange(span)) for _ in range(6000)]
    expected = plain_order([(m, t) for m, t, _ in sorted(data, key=lambda r: (r[2], r[1]))])
    got = consistency.timestamp_order(rows(ORDERED, *data).repartition(5))
    assert order_counts(got) == expected
    sizes = [r[0] for r in rows(ORDERED, *data).repartitionByRange(4, "machine", "ingest_seq", "ts").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2500


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 8192])
def test_periods_join_over_stretches(rows, chunk):
    """A long sensor that is bad most of the time, in stretches of any length, against one walk over it."""
    rng = random.Random(chunk)
    cells, expected = [], []
    for sensor, share in (("a", 0.9), ("b", 0.5), ("c", 1.0), ("d", 0.0)):
        last = None
        for h in range(300):
            if rng.random() < 0.05 and sensor != "c":
                continue  # the machine has no such tick: a period does not reach over it
            bad = rng.random() < share
            cells.append(("m", sensor, at(h), 1 if bad else 2, 3600, 2))
            if bad:
                if last is not None and h - last[1] == 1:
                    last[1], last[2] = h, last[2] + 1
                else:
                    last = [h, h, 1]
                    expected.append((sensor, last))
    grid = rows("machine string, sensor string, ts timestamp_ntz, n bigint, freq_s long, agg_freq long", *cells)
    got = missing.missing_intervals(grid.repartition(3), QualityConfig(orig_freq_s=1800), chunk)
    assert found(got, "sensor", "gap_start", "gap_end", "n_buckets") == sorted((s, at(a), at(b), n) for s, (a, b, n) in expected)


def test_order_of_nothing(rows):
    assert consistency.timestamp_order(rows(ORDERED)).collect() == []


def test_alarms(rows):
    data = rows(ROLLUP, *[("m", s, at(h), 360, 1.0, 360 - k, k) for s, alarms in
                          (("a", (0, 2, 1)), ("b", (0, 0, 0)), ("c", (3, 0, 0))) for h, k in enumerate(alarms)])
    frame = rollup.machine_frame(data)
    got = found(invalid.alarm_totals(data, frame), "total_readings", "total_readings_all_sensors", "total_alarms",
                "avg_alarms", "max_sensor", "max_alarms", "status")
    assert got == [(1080, 3240, 6, 1.0, "a", 3, "alarms")]
    assert found(invalid.alarms_by_sensor(data), "sensor", "alarms") == [("a", 3), ("c", 3)]
    assert found(invalid.alarm_buckets(rollup.annotate(data), 2), "sensor", "ts", "alarms") == [
        ("a", at(1), 2), ("c", at(0), 3)]
    quiet = data.where("sensor = 'b'")
    assert found(invalid.alarm_totals(quiet, frame), "total_alarms", "avg_alarms", "status") == [(0, None, "no_alarms")]


def test_invalid_counts(rows):
    data = rows(ROLLUP, ("m", "a", at(0), 360, 1.0, 350, 10))
    assert found(invalid.invalid_counts(data), "n_invalid", "invalid_pct") == [(10, pytest.approx(2.7778, abs=1e-4))]


def test_accuracy(rows):
    tag = "tag string, tag_description string, machine_group string, low_threshold string, high_threshold string, " \
          "threshold_type string, aggregation_rule string"
    known = rows(tag, ("A", "d", "g", "2", "4", "Up/Down", "avg"), ("b", "d", "g", None, None, "Up", "avg"),
                 ("c", "d", "g", "2", "4", "Down", "avg"))
    data = (series(rows, [1.0, 2.0, 3.0, 5.0, None]).unionByName(series(rows, [1.0], "b"))
            .unionByName(series(rows, [None], "c")).unionByName(series(rows, [1.0], "unknown")))
    assert found(accuracy.accuracy(data, known), "sensor", "n", "issues", "issue_pct", "status") == [
        ("a", 4, 2, 50.0, "accuracy_issues"), ("b", 1, 0, 0.0, "ok"), ("c", 0, 0, None, "no_valid_data")]
    assert found(accuracy.accuracy_issues(data, known), "sensor") == [("a",)]


def test_zscore_and_anomalies(rows):
    data = series(rows, [10.0] * 9 + [100.0]).unionByName(series(rows, [4.0] * 5, "flat"))
    assert found(outliers.zscore_outliers(data), "sensor", "outliers") == [("a", 0), ("flat", 0)]
    assert found(outliers.zscore_outliers(data, 2), "sensor", "outliers") == [("a", 1), ("flat", 0)]
    assert found(outliers.anomalies(data), "sensor", "ts", "value") == [("a", at(9), 100.0)]
