import re
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from meterline.operators import rollup
from meterline.plans.reports import quality_report
from meterline.schema import READINGS, QualityConfig
from meterline.session import scratch_path
from meterline.sources import streams
from meterline.streaming import jobs
from tests.conftest import SF, at, found
from workload import inputs

MEASURES = ["machine", "sensor", "bucket_start", "n", "sum_v", "n_valid", "n_invalid"]


def feed(spark, path, name, *readings):
    """One file of (machine, sensor, hour, value) readings."""
    rows = [(m, s, at(h), v, i) for i, (m, s, h, v) in enumerate(readings)]
    spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path):
    return streams.file_readings(spark, f"{path}/*", files_per_batch=1)


@pytest.fixture
def place(spark):
    return scratch_path(spark, "stream-test")


def run(start, result, place, name="out"):
    query = start(result, f"{place}/{name}", f"{place}/{name}-state")
    query.awaitTermination()
    return query


def test_update_mode_equals_batch_and_survives_a_restart(spark, place):
    feed(spark, f"{place}/in", "a", ("m", "s", 0.1, 1.0), ("m", "s", 0.2, 2.0), ("m", "t", 1.5, 3.0))
    run(jobs.start_upsert, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
    feed(spark, f"{place}/in", "b", ("m", "s", 0.9, 4.0), ("m", "s", 3.0, 5.0))
    run(jobs.start_upsert, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
    got = jobs.latest(spark, f"{place}/out")
    batch = rollup.rollup(spark.read.parquet(f"{place}/in/*"))
    assert found(got, *MEASURES) == found(batch, *MEASURES)
    assert ("m", "s", at(0), 3, 7.0, 3, 0) in found(got, *MEASURES)
    jobs.compact(spark, f"{place}/out", f"{place}/compact")
    assert found(spark.read.parquet(f"{place}/compact"), *MEASURES) == found(got, *MEASURES)


def test_late_rows_are_counted_by_a_listener(spark, place):
    late = jobs.LateRows()
    spark.streams.addListener(late)
    try:
        feed(spark, f"{place}/in", "a", ("m", "s", 0.1, 1.0), ("m", "s", 5.0, 2.0))
        run(jobs.start_append, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
        feed(spark, f"{place}/in", "b", ("m", "s", 0.5, 9.0), ("m", "s", 4.5, 3.0))
        second = run(jobs.start_append, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
        for _ in range(100):
            if late.total(second):
                break
            time.sleep(0.1)
        assert late.total(second) == jobs.dropped_late_rows(second) == 1
    finally:
        spark.streams.removeListener(late)


def test_append_mode_emits_closed_buckets_and_counts_late_rows(spark, place):
    feed(spark, f"{place}/in", "a", ("m", "s", 0.1, 1.0), ("m", "s", 5.0, 2.0))
    first = jobs.stream_rollup(stream(spark, f"{place}/in"))
    run(jobs.start_append, first, place)
    feed(spark, f"{place}/in", "b", ("m", "s", 0.5, 9.0), ("m", "s", 4.5, 3.0))
    second = run(jobs.start_append, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
    assert jobs.dropped_late_rows(second) == 1
    feed(spark, f"{place}/in", "c", ("m", "s", 9.0, 1.0))
    run(jobs.start_append, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
    got = found(spark.read.parquet(f"{place}/out"), "bucket_start", "n", "sum_v")
    assert got == [(at(0), 1, 1.0), (at(4), 1, 3.0), (at(5), 1, 2.0)]


def test_repeats(spark, place):
    feed(spark, f"{place}/in", "a", ("m", "s", 0.1, 1.0), ("m", "s", 0.1, 1.0), ("m", "t", 0.1, 1.0))
    feed(spark, f"{place}/in", "b", ("m", "s", 0.1, 1.0), ("m", "s", 0.2, 1.0))
    run(jobs.start_append, jobs.drop_repeats(stream(spark, f"{place}/in")), place)
    assert found(spark.read.parquet(f"{place}/out"), "sensor", "ts") == [
        ("s", at(0.1)), ("s", at(0.2)), ("t", at(0.1))]


def test_alarms_and_gaps(spark, place):
    known = spark.sql("SELECT 's' AS tag, '' AS tag_description, '' AS machine_group, NULL AS low_threshold, "
                      "'5' AS high_threshold, 'Up' AS threshold_type, 'max' AS aggregation_rule")
    full = [("m", "s", h + k / 4, 1.0) for h in (0, 3, 5, 12) for k in range(2)]
    feed(spark, f"{place}/in", "a", *full, ("m", "s", 1.5, 9.0), ("m", "s", 2.0, 1.0), ("m", "s", 4.0, 1.0))
    run(jobs.start_append, jobs.stream_alarms(stream(spark, f"{place}/in"), known), place, "alarms")
    assert found(spark.read.parquet(f"{place}/alarms"), "ts", "mean", "alarms") == [(at(1), 9.0, 1)]
    gaps = jobs.stream_gaps(stream(spark, f"{place}/in"), QualityConfig(orig_freq_s=1800))
    run(jobs.start_append, gaps, place, "gaps")
    assert found(spark.read.parquet(f"{place}/gaps"), "gap_start", "gap_end", "n_buckets") == [
        (at(1), at(2), 2), (at(4), at(4), 1)]


def test_gap_watch_sees_dead_sensors_and_machines(spark, place):
    sensors = spark.sql("SELECT *, timestamp '2024-01-01' AS since FROM VALUES ('m', 's'), ('m', 't'), ('dead', 'u') AS x(machine, sensor)")
    config = QualityConfig(orig_freq_s=1800)

    def watch():
        query = jobs.start_gap_watch(jobs.stream_rollup(stream(spark, f"{place}/in")), sensors, config, f"{place}/gaps", f"{place}/state")
        query.awaitTermination()
        return query

    full = lambda sensor, *hours: [("m", sensor, h + k / 4, 1.0) for h in hours for k in range(2)]
    feed(spark, f"{place}/in", "a", *full("s", 0, 1, 3, 4), *full("t", 0), ("m", "s", 6.0, 1.0))
    watch()
    closed = lambda: found(jobs.closed_gaps(spark, f"{place}/gaps"), "machine", "sensor", "gap_start", "gap_end", "n_buckets")
    opened = lambda: found(jobs.open_gaps(spark, f"{place}/gaps"), "machine", "sensor", "gap_start")
    assert closed() == [("m", "s", at(2), at(2), 1)]
    assert opened() == [("dead", "u", at(0)), ("m", "t", at(1))]
    feed(spark, f"{place}/in", "b", *full("s", 5, 6, 7, 8), *full("t", 6, 7, 8), *full("new", 8), ("m", "s", 12.0, 1.0))
    last = watch()
    assert closed() == [("m", "s", at(2), at(2), 1), ("m", "t", at(1), at(5), 5)]
    assert opened() == [("dead", "u", at(0)), ("m", "new", at(9)), ("m", "s", at(9)), ("m", "t", at(9))]
    # A state row a sensor, and nothing that was written is read again.
    states = [o for p in last.recentProgress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert max(o["numRowsTotal"] for o in states) <= 4 * 3  # values, timers and the timers' index
    assert not [c for c in (last.recentProgress[-1].get("sources") or []) if "gaps" in c["description"]]


def test_gap_state_is_constant_over_a_thousand_batches():
    """The processor alone, batch by batch, against runs found in the whole history."""
    import random
    from types import SimpleNamespace

    from meterline.streaming.gaps import GapProcessor

    class Handle:
        def __init__(self):
            self.timers, self.value, self.most = set(), None, 0

        def getValueState(self, name, schema):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, ms):
            self.timers.add(ms)
            self.most = max(self.most, len(self.timers))

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    rng, step, handle = random.Random(4), 3600, Handle()
    processor = GapProcessor(step, 2)
    processor.init(handle)
    processor.handleInitialState(("m", "s"), iter([SimpleNamespace(since_s=5)]), None)
    good, closed, opened, now = set(), [], [], step
    for _ in range(1000):
        upto = now + step * rng.choice([0, 1, 1, 2, 7])
        rows = []
        for start in range(now, upto, step):
            n = rng.choice([None, 0, 1, 2, 3])
            if n is not None:
                rows.append(SimpleNamespace(bucket_start=SimpleNamespace(timestamp=lambda s=start: float(s)), n=n))
            good |= {start} if n and n >= 2 else set()
        rng.shuffle(rows)
        out = list(processor.handleInputRows(("m", "s"), iter(rows), None)) if rows else []
        watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: upto * 1000 + 17)
        for ms in [t for t in handle.timers if t <= upto * 1000]:
            handle.timers.remove(ms)
            out += list(processor.handleExpiredTimer(("m", "s"), watermark, None))
        closed += [(int(r.gap_start.timestamp()), r.n_buckets) for r in out if r.event == "closed"]
        opened += [int(r.gap_start.timestamp()) for r in out if r.event == "open"]
        now = upto
        assert len(handle.timers) == 1 and len(handle.value) == 3
    expected, start = [], None
    for b in range(step, now, step):
        if b in good and start is not None:
            expected.append((start, (b - start) // step))
            start = None
        elif b not in good and start is None:
            start = b
    assert handle.most == 1 and closed == expected and len(expected) > 100
    assert opened == [g for g, _ in expected] + ([start] if start is not None else [])


def test_log_reads_touch_the_asked_days_and_the_newest_run_wins(spark, place):
    for day in range(4):
        feed(spark, f"{place}/in", f"d{day}", ("m", "s", 24 * day + 0.1, 1.0))
    run(jobs.start_upsert, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
    whole, one = jobs.latest(spark, f"{place}/out"), jobs.latest(spark, f"{place}/out", days=[at(24).date()])
    assert whole.count() == 4 and found(one, "bucket_start") == [(at(24),)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)
    anew = jobs.stream_rollup(stream(spark, f"{place}/in"))
    jobs.start_upsert(anew.withColumn("sum_v", F.lit(5.0)), f"{place}/out", f"{place}/second", run="1").awaitTermination()
    assert {r.sum_v for r in jobs.latest(spark, f"{place}/out").collect()} == {5.0}


def test_closed_days_fold_into_the_table(spark, place):
    for day in range(3):
        feed(spark, f"{place}/in", f"d{day}", ("m", "s", 24 * day + 0.1, 1.0 + day), ("m", "t", 24 * day + 5.1, 2.0))
    run(jobs.start_upsert, jobs.stream_rollup(stream(spark, f"{place}/in")), place)
    before = found(jobs.latest(spark, f"{place}/out"), *MEASURES)
    assert jobs.fold_closed_days(spark, f"{place}/out", f"{place}/table", at(48).date()) == 2
    assert found(jobs.latest(spark, f"{place}/out"), "bucket_start") == [(at(48),), (at(53),)]
    assert found(jobs.folded(spark, f"{place}/out", f"{place}/table"), *MEASURES) == before
    assert jobs.fold_closed_days(spark, f"{place}/out", f"{place}/table", at(48).date()) == 0
    # A day that comes again with a newer run replaces its rows only.
    again = jobs.stream_rollup(stream(spark, f"{place}/in")).where("sensor = 's'").withColumn("sum_v", F.lit(9.0))
    jobs.start_upsert(again, f"{place}/out", f"{place}/second", run="1").awaitTermination()
    assert jobs.fold_closed_days(spark, f"{place}/out", f"{place}/table", at(96).date()) == 3
    got = found(jobs.folded(spark, f"{place}/out", f"{place}/table"), "sensor", "bucket_start", "sum_v")
    assert got == [("s", at(0), 9.0), ("s", at(24), 9.0), ("s", at(48), 9.0), ("t", at(5), 2.0), ("t", at(29), 2.0), ("t", at(53), 2.0)]


def test_silent_sensors(spark, place):
    feed(spark, f"{place}/in", "a", ("m", "s", 0.1, 1.0), ("m", "t", 0.1, 1.0), ("m", "s", 1.1, 1.0), ("m", "s", 9, 1.0))
    sensors = spark.sql("SELECT 'm' AS machine, explode(array('s', 't')) AS sensor")
    jobs.start_silence_watch(jobs.stream_rollup(stream(spark, f"{place}/in")), sensors, f"{place}/closed",
                             f"{place}/silent", f"{place}/state").awaitTermination()
    assert found(spark.read.parquet(f"{place}/silent"), "sensor", "bucket_start") == [("t", at(1))]


def test_report_per_batch_covers_whole_touched_buckets(spark, place):
    feed(spark, f"{place}/in", "a", ("m", "click", 0.1, 1.0), ("m", "view", 0.2, 2.0), ("m", "view", 1.2, 2.0))
    config, known = QualityConfig(orig_freq_s=1800), inputs.event_dictionary(spark)

    def watch():
        jobs.start_quality_watch(jobs.stream_rollup(stream(spark, f"{place}/in")), known, config, f"{place}/table",
                                 f"{place}/report", f"{place}/state").awaitTermination()

    watch()
    feed(spark, f"{place}/in", "b", ("m", "click", 0.3, 3.0))
    watch()
    report = spark.read.parquet(f"{place}/report")
    last = report.where(F.col("batch_id") == report.agg(F.max("batch_id")).first()[0])
    assert found(last.where("metric = 'mean'"), "sensor", "value") == [("click", 2.0), ("view", 2.0)]


def test_json_messages(spark):
    messages = spark.createDataFrame([(b'{"machine":"m","sensor":"A1","ts":"2024-01-01T00:00:00Z","value":2.5}',)],
                                     "value binary")
    assert found(streams.parse_json(messages), "machine", "sensor", "ts", "value") == [("m", "a1", at(0), 2.5)]


def test_report_statuses(spark, rows):
    values = [("a", h, float(h)) for h in range(30)] + [("b", h, float(-h)) for h in range(30)] + [("c", 0, 500.0)]
    stored = rows("machine string, sensor string, bucket_start timestamp_ntz, n bigint, sum_v double, n_valid bigint, "
                  "n_invalid bigint", *[("m", s, at(h), 1, v, 1, 0) for s, h, v in values])
    readings = rows("machine string, ts timestamp_ntz, ingest_seq long", ("m", at(1), 1), ("m", at(0), 2))
    report = quality_report(stored, inputs.event_dictionary(spark), QualityConfig(orig_freq_s=1800), readings).cache()
    status = {(r["sensor"], r["metric"]): (r["value"], r["status"]) for r in report.collect()}
    assert status["a", "r:b"] == (pytest.approx(-1.0), "strong")
    assert status["c", "complete_pct"] == (pytest.approx(100 / 30), "below_threshold")
    assert status["a", "complete_pct"] == (100.0, "ok")
    assert status[None, "n_backward"] == (1.0, "out_of_order")
    assert status[None, "total_points"][0] == 90.0 and status[None, "total_missing"][0] == 29.0
    assert status[None, "end_epoch_s"][0] - status[None, "start_epoch_s"][0] == timedelta(hours=29).total_seconds()


HISTORY_CHECKS = ("general", "describe", "missing", "completeness", "outliers", "accuracy")


def test_history_report_equals_the_batch_report_after_every_batch(spark, place):
    import random

    from meterline.streaming import history

    rng, config, known = random.Random(6), QualityConfig(orig_freq_s=1800), inputs.event_dictionary(spark)

    def feed_days(name, machine, first, days):
        values = [(machine, s, h + 0.1, rng.choice([rng.gauss(60, 30), rng.gauss(60, 30), 0.0, -2.5, 5e6, 1e-3]))
                  for h in range(24 * first, 24 * (first + days), 2) for s in ("click", "view", "other") if rng.random() < 0.7]
        feed(spark, f"{place}/in", name, *values)

    def watch(checkpoint, run="0"):
        rolled = jobs.stream_rollup(stream(spark, f"{place}/in"))
        history.start_history_watch(rolled, known, config, f"{place}/history", f"{place}/{checkpoint}", run=run).awaitTermination()

    def expected(run, batch_id):
        values = spark.read.parquet(f"{place}/history/values/run={run}").where(F.col("batch_id") <= batch_id)
        rolled = values.select("machine", "sensor", F.col("ts").alias("bucket_start"), F.lit(1).alias("n"), F.col("mean").alias("sum_v"), F.lit(1).alias("n_valid"), F.lit(0).alias("n_invalid"))
        return quality_report(rolled, known, config).where(F.col("check").isin(*HISTORY_CHECKS))

    def cells(df):
        return {(r.machine, r.sensor, r.check, r.metric): (r.value and round(r.value, 6), r.status) for r in df.collect()}

    feed_days("a", "m", 0, 4)
    watch("state")
    feed_days("b", "m", 4, 5)
    feed_days("c", "n", 4, 5)
    watch("state")
    reports = spark.read.parquet(f"{place}/history/report")
    batches = sorted({r.batch_id for r in reports.select("batch_id").distinct().collect()})
    assert len(batches) >= 3
    for batch_id in (batches[1], batches[-1]):
        got = cells(reports.where(F.col("batch_id") == batch_id))
        assert got and got == cells(expected("0", batch_id))
    assert cells(history.latest_report(spark, f"{place}/history")) == cells(expected("0", batches[-1]))
    # Two states are kept, and a start with a new checkpoint adds a run without touching the one before.
    assert spark.read.parquet(f"{place}/history/moments").select("batch_id").distinct().count() <= 2
    before = reports.where("run = '0'").count()
    watch("state-2", run="1")
    again = spark.read.parquet(f"{place}/history/report")
    assert again.where("run = 0").count() == before
    assert cells(history.latest_report(spark, f"{place}/history")) == cells(expected("1", again.where("run = 1").agg(F.max("batch_id")).first()[0]))


def test_value_bins_rise_with_the_value(spark):
    from meterline.operators.quantiles import value_bin

    xs = sorted([float("-inf"), -1e308, -5e6, -1.0, -1e-9, -0.0, 0.0, 1e-300, 0.5, 0.51, 1.0, 2.0, 1e9, 1.7e308, float("inf")])
    bins = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", value_bin(F.col("x")).alias("b")).orderBy("x").collect()]
    assert bins == sorted(bins) and len(set(bins)) >= 10


def test_a_new_run_of_a_watch_keeps_what_the_old_one_wrote(spark, place):
    sensors = spark.sql("SELECT 'm' AS machine, explode(array('s', 't')) AS sensor")
    feed(spark, f"{place}/in", "a", ("m", "s", 0.1, 1.0), ("m", "t", 0.1, 1.0), ("m", "s", 1.1, 1.0), ("m", "s", 9, 1.0))
    for run_name in ("0", "1"):
        jobs.start_silence_watch(jobs.stream_rollup(stream(spark, f"{place}/in")), sensors, f"{place}/closed", f"{place}/silent",
                                 f"{place}/state-{run_name}", run=run_name).awaitTermination()
    silent = spark.read.parquet(f"{place}/silent")
    assert {r.run for r in silent.collect()} == {0, 1} and silent.count() == 2
    assert spark.read.parquet(f"{place}/closed").select("run").distinct().count() == 2
