"""Alarms and invalid readings per bucket, sensor and machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["machine", "sensor"]


def alarms_by_sensor(rolled: DataFrame) -> DataFrame:
    """(machine, sensor, alarms) of the sensors with at least one alarm."""
    return (rolled.groupBy(*KEYS).agg(F.sum("n_invalid").alias("alarms"), F.max("n_invalid").alias("worst"))
            .where("worst > 0").drop("worst"))


def alarm_totals(rolled: DataFrame, frame: DataFrame) -> DataFrame:
    """Per machine, over the sensors with alarms.

    *frame* is the ``machine_frame``: buckets without a reading count as buckets without an
    alarm.  ``total_readings`` is ticks times expected readings per bucket, for one sensor;
    ``total_readings_all_sensors`` counts all of them.  ``avg_alarms`` is the mean of the
    per-sensor bucket means.  The first sensor in name order wins a tie for the most alarms.
    """
    per_sensor = rolled.groupBy(*KEYS).agg(
        F.sum("n_invalid").alias("alarms"), F.max("n_invalid").alias("worst"),
        F.count_if(F.col("n_invalid").isNull()).alias("unknown")).join(frame, "machine")
    alarming = F.col("worst") > 0
    avg_alarms = F.try_divide(F.col("alarms"), F.col("rows") - F.col("unknown"))
    totals = per_sensor.groupBy("machine").agg(
        (F.max("rows") * F.max("agg_freq")).alias("total_readings"),
        (F.sum("rows") * F.max("agg_freq")).alias("total_readings_all_sensors"),
        F.count_if(alarming).alias("sensors_with_alarms"),
        F.coalesce(F.sum(F.when(alarming, F.col("alarms"))), F.lit(0)).alias("total_alarms"),
        F.avg(F.when(alarming, avg_alarms)).alias("avg_alarms"),
        F.min(F.when(alarming, F.struct((-F.col("alarms")).alias("order"), F.col("sensor").alias("sensor"))))
        .alias("top"))
    return totals.select(
        "machine", "total_readings", "total_readings_all_sensors", "sensors_with_alarms", "total_alarms",
        "avg_alarms", F.col("top.sensor").alias("max_sensor"), (-F.col("top.order")).alias("max_alarms"),
        F.when(F.col("total_alarms") > 0, "alarms").otherwise("no_alarms").alias("status"))


def invalid_counts(rolled: DataFrame, agg_freq: int = 360) -> DataFrame:
    """Per bucket: invalid readings (all minus valid) and their share of the expected ones."""
    n_invalid = F.col("n") - F.col("n_valid")
    return rolled.select(*KEYS, "bucket_start", n_invalid.alias("n_invalid"),
                         (F.try_divide(n_invalid, F.lit(agg_freq)) * 100).alias("invalid_pct"))


def alarm_buckets(annotated: DataFrame, threshold: int = 1) -> DataFrame:
    """(machine, sensor, ts, mean, alarms) of the buckets with *threshold* alarms or more."""
    return annotated.where(F.col("alarms") >= threshold).select(*KEYS, "ts", "mean", "alarms")


def at_buckets(buckets: DataFrame, series: DataFrame) -> DataFrame:
    """The mean at chosen buckets when both are stored apart."""
    return buckets.select(*KEYS, "ts").join(series.select(*KEYS, "ts", "mean"), [*KEYS, "ts"])
