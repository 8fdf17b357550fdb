"""The given tables seen as sensor readings and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.arrival import with_stored_order
from meterline.operators.rollup import as_series, calendar_grid, machine_frame, machine_grid, rollup
from meterline.schema import QualityConfig
from meterline.session import settle
from meterline.sources.dictionary import normalise
from meterline.sources.streams import file_readings
from meterline.sources.tables import as_readings

# events has about three rows per sensor and hour at the small scale, so two
# expected readings per hour leave real gaps.
EVENTS = QualityConfig(orig_freq_s=1800, bucket="1 hour")
LINES = QualityConfig(orig_freq_s=43200, bucket="1 day")

EVENT_DICTIONARY = """
SELECT * FROM VALUES
  ('click',    'clicks per visitor', 'M-1', CAST(NULL AS STRING), '120', 'Up', 'max', 'count', 'Load'),
  ('purchase', 'purchase amount', 'M-1', '5', NULL, 'Down', 'min', 'eur', 'Money'),
  ('view',     NULL, 'M-1', '1', '150', 'Up/Down', 'avg', 'count', 'Load'),
  ('signup',   'sign-ups ', 'M-2', '1,799,999,952,316,280', NULL, 'Down', 'min', 'Count', NULL),
  ('error',    'errors', 'M-2', NULL, NULL, NULL, 'avg', 'count', NULL)
AS t(tag, tag_description, machine_group, low_threshold, high_threshold, threshold_type,
     aggregation_rule, engineering_units, category)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_dictionary(spark: SparkSession) -> DataFrame:
    return spark.sql(EVENT_DICTIONARY)


def _event_columns(events: DataFrame) -> DataFrame:
    machine = F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string"))
    return as_readings(events, machine, "event_type", "ts", "value", "event_id")


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_columns(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # A pattern serves a single file and a folder of part files alike.
    return _event_columns(file_readings(spark, f"{sf_dir}/events.parquet*", schema))


def expected_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(machine, sensor, since): every sensor of the events, owed from the hour of the first event on."""
    sensors = event_readings(spark, sf_dir).groupBy("machine", "sensor").agg(F.min("ts").alias("lo"))
    since = sensors.agg(F.date_trunc("hour", F.min("lo")).alias("since"))
    return settle(sensors.select("machine", "sensor", since.scalar().alias("since")), "sensors")


def event_rollup(spark: SparkSession, sf_dir: str, extremes: bool = False, judged: bool = True) -> DataFrame:
    """Hourly rollup; ``judged=False`` leaves the limits out where a query only counts readings."""
    known = event_dictionary(spark) if judged else None
    return rollup(event_readings(spark, sf_dir), known, EVENTS.bucket, extremes)


def stable_mean(grid: DataFrame) -> DataFrame:
    """Means kept to six decimals, so no later comparison hangs on the order of a sum."""
    return grid.withColumn("mean", F.round(F.col("mean") + F.lit(1e-9), 6))


def event_grid(spark: SparkSession, sf_dir: str, judged: bool = False) -> DataFrame:
    """Grid of the hourly event means; the rollup is stored once because the grid reads it three times."""
    stored = settle(event_rollup(spark, sf_dir, judged=judged), "hourly")
    return stable_mean(machine_grid(stored, EVENTS.orig_freq_s))


def stored_event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hourly rollup with stable means; one row per bucket that has a reading."""
    return settle(stable_mean(as_series(event_rollup(spark, sf_dir, judged=False))), "hourly")


def frame_of(series: DataFrame) -> DataFrame:
    return machine_frame(series.withColumnRenamed("ts", "bucket_start"), EVENTS.orig_freq_s)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per sensor and calendar hour, zero where silent: a series without holes."""
    stored = settle(event_rollup(spark, sf_dir, judged=False), "hourly")
    return calendar_grid(stored, EVENTS.bucket, EVENTS.orig_freq_s).withColumn("mean", F.col("n").cast("double"))


def line_readings(spark: SparkSession, sf_dir: str, number: str | None = None, placed: bool = False) -> DataFrame:
    """Lines as readings, without an arrival number unless one is named; *placed* keeps each row's place in the files."""
    lines = table(spark, sf_dir, "lineitem")
    return as_readings(with_stored_order(lines) if placed else lines, "l_linestatus", "l_returnflag", "l_shipdate",
                       "l_extendedprice", number)


def stored_line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(stable_mean(as_series(rollup(line_readings(spark, sf_dir), bucket=LINES.bucket))), "daily")


def line_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = settle(rollup(line_readings(spark, sf_dir), bucket=LINES.bucket), "daily")
    return stable_mean(machine_grid(stored, LINES.orig_freq_s))


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderdate",
                       "o_totalprice", "o_orderkey")


def part_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that grows with the data: one sensor per part, with every kind of defect."""
    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    k = F.col("k")
    low = (F.when(k % 13 == 0, F.concat(F.lit("1,799,"), k.cast("string")))
           .when(k % 11 != 0, F.col("p_size").cast("string")))
    high = F.when(k % 17 == 0, (F.col("p_size") - 5).cast("string")).when(k % 19 != 0, (F.col("p_size") + 20).cast("string"))
    kind = F.when(k % 4 == 0, "Down").when(k % 4 == 1, "Up").when(k % 4 == 2, "Up/Down")
    unit = F.when(k % 5 == 0, "Kg/cm2").when(k % 5 == 1, "Kgf/cm2").when(k % 5 == 2, "mm").otherwise("kg/cm2")
    rows = part.select(
        F.concat(F.lit("P"), k.cast("string")).alias("tag"),
        F.when(k % 7 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name")).alias("tag_description"),
        F.col("p_brand").alias("machine_group"), low.alias("low_threshold"), high.alias("high_threshold"),
        kind.alias("threshold_type"), F.lit("avg").alias("aggregation_rule"), unit.alias("engineering_units"),
        F.col("p_type").alias("category"))
    return normalise(rows)


def part_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities per part; some ids lie beyond the dictionary."""
    key = (F.col("l_partkey") + F.col("l_suppkey")).cast("string")
    return as_readings(table(spark, sf_dir, "lineitem"), "l_linestatus", F.concat(F.lit("P"), key),
                       "l_shipdate", "l_quantity")
