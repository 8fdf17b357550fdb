import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterline.functions import salted_join
from meterline.operators import accuracy, consistency, missing, outliers, profile, rollup, timeseries
from meterline.plans import reports
from meterline.schema import QualityConfig
from meterline.session import build_session, scratch_path, settle, workdir
from meterline.sources import dictionary as dictionary_source
from meterline.sources import streams, tables
from tests.conftest import SF, at, found
from workload import inputs
from workload.oracle import SQL
from workload.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark):
    return settle(inputs.event_rollup(spark, SF), "hourly")


def single_partition_windows(text: str) -> bool:
    return bool(re.search(r"SinglePartition", text))


def test_rollup_plan(spark):
    text = plan(inputs.event_rollup(spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert schemas and all("props" not in s for s in schemas)
    assert text.count("HashAggregate") >= 2 and "Python" not in text


def test_no_operator_gathers_data_in_one_partition(spark, stored):
    series, frame = rollup.as_series(stored), rollup.machine_frame(stored, 1800)
    grid, known = rollup.machine_grid(stored, 1800), inputs.event_dictionary(spark)
    for df in (missing.missing_readings(stored), missing.missing_intervals(grid), profile.completeness(series, frame=frame),
               profile.describe(series), outliers.iqr_outliers(series, frame=frame), outliers.anomalies(series),
               accuracy.accuracy(series, known), timeseries.rolling_mean(grid), timeseries.seasonal_decompose(grid),
               consistency.duplicate_ticks(series), consistency.timestamp_order(inputs.event_readings(spark, SF))):
        text = plan(df)
        assert not single_partition_windows(text), text
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_sensor_filter_reaches_the_scan(spark, stored):
    path = scratch_path(spark, "rollup")
    tables.write_rollup(stored, path)
    again = tables.read_rollup(spark, path)
    assert again.exceptAll(stored).isEmpty() and stored.exceptAll(again).isEmpty()
    text = plan(again.where("machine = 'm0' and sensor = 'click'").select("n"))
    assert "PartitionFilters: [isnotnull(machine" in text and "EqualTo(sensor,click)" in text


def test_dictionary_csv(spark, tmp_path):
    (tmp_path / "tags.csv").write_text(
        "TAG,Tag Description,MACHINE_GROUP,LOW_THRESHOLD,HIGH_THRESHOLD,THRESHOLD_TYPE,AGGREGATION_RULE,"
        "ENGINEERING_UNITS,CATEGORY\n"
        'AB1,OIL PRESSURE ,K-1,"1,799,999",,Down,min,kg/cm2,Pressure\nAB2,SPEED,K-1,,,,avg,rpm,\n')
    got = dictionary_source.read_dictionary(spark, str(tmp_path / "tags.csv"))
    assert found(got, "tag", "tag_description", "low_threshold", "threshold_type") == [
        ("ab1", "OIL PRESSURE ", "1,799,999", "Down"), ("ab2", "SPEED", None, None)]


def test_catalogue(spark, stored):
    wide = spark.createDataFrame([(at(0), 4.0, 2, 1)], "TIMESTAMP timestamp, SUM_COLx double, COUNT_COLx bigint, "
                                                      "COUNT_COLx_ISVALID bigint")
    wide.write.saveAsTable("pump_1_HOURS")
    wide.write.saveAsTable("pump_1_days")
    assert tables.machine_tables(spark) == ["pump_1_hours"]
    table = tables.read_machine_table(spark, "pump_1_hours")
    loaded = reports.load_machine(table, "pump_1", inputs.event_dictionary(spark), QualityConfig())
    assert found(loaded.annotated, "machine", "sensor", "mean", "alarms") == [("pump_1", "x", 2.0, 1)]
    assert loaded.tags.isEmpty() and found(loaded.frequency, "status") == [("not_assessable",)]


def test_connection(monkeypatch):
    for name, value in (("DB_IP", "10.1.1.1"), ("DB_PORT", "1529"), ("DB_USER", "reader"), ("DB_PASS", "x")):
        monkeypatch.setenv(name, value)
    monkeypatch.delenv("DB_NAME", raising=False)
    with pytest.raises(ValueError, match="DB_NAME"):
        tables.Connection.from_env()
    options = tables.jdbc_options(tables.Connection.from_env(database="plant"), "pump_hours", "2024-01-01", "2025-01-01", 8)
    assert options["url"] == "jdbc:postgresql://10.1.1.1:1529/plant" and options["user"] == "reader"
    assert options["partitionColumn"] == "timestamp" and options["numPartitions"] == "8"


def test_jdbc_reads_are_always_split(spark, monkeypatch):
    """No database here: the options of each read are looked at in its place."""
    asked = []

    def load(_, options):
        asked.append(options)
        return spark.sql("SELECT timestamp'2024-01-01' AS LO, timestamp'2024-06-01' AS HI")
    monkeypatch.setattr(tables, "_jdbc", load)
    connection = tables.Connection("u", "p", "h", "1", "d")
    tables.read_machine_table_jdbc(spark, connection, "pump_hours", partitions=4)
    assert "min(timestamp)" in asked[0]["dbtable"] and asked[1]["lowerBound"].startswith("2024-01-01")
    assert asked[1]["numPartitions"] == "4" and asked[1]["partitionColumn"] == "timestamp"
    tables.machine_tables_jdbc(spark, connection)
    assert "information_schema" in asked[2]["dbtable"]


def test_dictionary_goes_by_header(spark, rows, tmp_path):
    (tmp_path / "tags.csv").write_text("MACHINE_GROUP,TAG,Tag Description,LOW_THRESHOLD,HIGH_THRESHOLD,THRESHOLD_TYPE,AGGREGATION_RULE,"
                                       "ENGINEERING_UNITS,CATEGORY,more\nM-1,AB,pump ,\"1,799\",5,Up,max,mm,c,x\n")
    got = dictionary_source.read_dictionary(spark, str(tmp_path / "tags.csv"))
    assert [tuple(r) for r in got.collect()] == [("ab", "pump ", "M-1", "1,799", "5", "Up", "max", "mm", "c")]
    (tmp_path / "short.csv").write_text("TAG,CATEGORY\na,b\n")
    with pytest.raises(ValueError, match="tag_description"):
        dictionary_source.read_dictionary(spark, str(tmp_path / "short.csv"))


def test_bad_messages_are_kept_apart(rows):
    messages = rows("value string", ('{"machine": "m", "sensor": "A", "ts": "2024-01-01T00:00:00Z", "value": 1.5}',), ("no json",),
                    ('{"machine": "m", "sensor": "a"}',), (None,))
    assert found(streams.parse_json(messages), "sensor", "value") == [("a", 1.5)]
    assert streams.rejected_json(messages).count() == 3


def test_readings_are_cleaned(rows):
    raw = rows("m int, s string, t timestamp_ntz, v double", (1, "AB", at(0), float("nan")), (1, "AB", at(1), 2.0))
    assert found(tables.as_readings(raw, "m", "s", "t", "v"), "machine", "sensor", "value") == [
        ("1", "ab", None), ("1", "ab", 2.0)]


def test_csv_export(spark, stored):
    path = scratch_path(spark, "csv")
    annotated = rollup.annotate(rollup.machine_grid(stored, 1800))
    tables.write_annotated_csv(annotated, path, ["click", "view"])
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["machine", "ts", "click", "click_alarms", "view", "view_alarms"]
    assert back.count() == rollup.ticks(stored).count()


def test_exploration(spark, stored):
    grid = rollup.machine_grid(stored, 1800)
    page = reports.explore(grid, inputs.event_dictionary(spark), ["click", "view"])
    assert found(page.correlation, "sensor_a", "sensor_b")[0] == ("click", "view")
    assert {s for s, in found(page.describe, "sensor")} == {"click", "view"}
    assert page.fliers.count() == page.box.agg(F.sum("fliers")).first()[0]
    assert found(page.decomposition.select("status").distinct(), "status") == [("has_nulls",)]
    report = reports.missing_report(stored, grid, inputs.EVENTS)
    assert report.gaps.count() == 10 and report.intervals.count() > 0
    invalid = reports.invalid_report(stored, inputs.EVENTS)
    assert invalid.buckets.count() == invalid.summary.agg(F.sum("alarm_buckets")).first()[0]


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    data = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 50) END AS sensor", "id AS ts")
    stats = spark.range(40).selectExpr("concat('s', id) AS sensor", "id AS v").union(
        spark.sql("SELECT 'hot', 99L"))
    for how in ("inner", "left"):
        plain, salted = data.join(stats, "sensor", how), salted_join(data, stats, ["sensor"], "ts", how=how)
        assert plain.exceptAll(salted.select(plain.columns)).isEmpty() and plain.count() == salted.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(salted_join(data, stats, ["sensor"], "ts").groupBy("sensor").count())
        # sensor and salt place the rows; only partial counts meet per sensor
        assert re.search(r"hashpartitioning\(sensor#\d+, _salt#\d+", text)
        assert text.count("HashAggregate") >= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_of_a_dictionary_from_files_count_for_its_broadcast(spark):
    """3,000 sensors in a few compressed KB are 24,000 rows in the join."""
    path = scratch_path(spark, "dictionary")
    spark.range(3000).coalesce(1).selectExpr(
        "concat('S', id) AS tag", "'d' AS tag_description", "'g' AS machine_group", "'1' AS low_threshold", "'2' AS high_threshold",
        "'Up/Down' AS threshold_type", "'avg' AS aggregation_rule").write.parquet(path)
    known = spark.read.parquet(path)
    data = spark.range(20_000).selectExpr("'m' AS machine", "concat('s', id % 4000) AS sensor", "id AS ts", "CAST(id % 4 AS DOUBLE) AS mean")
    stored = sum(f.stat().st_size for f in Path(path.removeprefix("file:")).glob("*.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(stored))
    try:
        assessed = accuracy.accuracy(data, known)
        assert "SortMergeJoin" in plan(assessed)
        assert "SortMergeJoin" not in plan(accuracy.accuracy(data, known.limit(2))) and "SortMergeJoin" not in plan(accuracy.accuracy(data, inputs.event_dictionary(spark)))
        assert assessed.agg(F.count("n"), F.sum("n"), F.sum("issues")).first() == (3000, 15_000, 7500)
        # A sensor's five readings are all i % 4, since 4,000 is a multiple of 4.
        assert assessed.where("issues > 0").agg(F.min("issues"), F.max("issues"), F.count("issues")).first() == (5, 5, 1500)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_session_settings(spark):
    assert workdir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session().sparkContext is spark.sparkContext


def test_wide_lines_equal_the_pivot_and_hold_any_number_of_sensors(spark):
    """Holes at every place, null means, quoted names; then twice as many sensors as a pivot takes."""
    rows = [("m", s, at(h), None if (h + i) % 5 == 0 else h + i / 4, (h * i) % 3) for h in range(6) for i, s in enumerate(["a", "b", "c,d", "e", "f"])
            if (h * 5 + i) % 4 or h == 0]
    annotated = spark.createDataFrame(rows + [("k", "e", at(2), 1e300, 0)], "machine string, sensor string, ts timestamp_ntz, mean double, alarms bigint")
    wide, lines = scratch_path(spark, "wide"), scratch_path(spark, "lines")
    tables.write_annotated_csv(annotated.coalesce(1), wide)
    tables.write_wide_csv(annotated, lines)
    old = [r.value for r in spark.read.text(wide).collect()]
    header = [r.value for r in spark.read.text(f"{lines}/header").collect()]
    assert header[0].replace('"', "") in {line.replace('"', "") for line in old} and len(header) == 1
    body = sorted(line.replace('""', "") for line in old if not line.startswith("machine,"))
    assert sorted(r.value.replace('""', "") for r in spark.read.text(f"{lines}/rows").collect()) == body and len(body) == 7

    many = spark.range(20_000).selectExpr("'m' AS machine", "'s' || id AS sensor", "timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id % 3 AS int)) AS ts",
                                          "id / 8D AS mean", "id % 2 AS alarms")
    tables.write_wide_csv(many, lines)
    back = tables.read_wide_csv(spark, lines)
    assert back.count() == 20_000 and back.agg({"mean": "sum"}).first()[0] == many.agg({"mean": "sum"}).first()[0]
    assert back.where("sensor = 's777'").select("mean", "alarms").first() == (777 / 8, 1)
    assert {line.value.count(",") for line in spark.read.text(f"{lines}/rows").collect()} == {40_001}
