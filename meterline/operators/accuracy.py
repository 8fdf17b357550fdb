"""Share of values outside the nominal limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import measure_hot, salted_join, violates_limits
from meterline.operators.dictionary import limits

KEYS = ["machine", "sensor"]


def accuracy(series: DataFrame, dictionary: DataFrame, value: str = "mean", measured: bool = False) -> DataFrame:
    """(machine, sensor, n, issues, issue_pct, status) of every sensor in the dictionary.

    The share is over non-null values.  With a dictionary whose copies are small enough to broadcast,
    values fold to counts before anything is shuffled.  With *measured* a job finds the hot sensors first,
    and only they are spread, by their share.
    """
    known = limits(dictionary).select("sensor", "low_limit", "high_limit")
    values = series.select("machine", F.lower("sensor").alias("sensor"), "ts", F.col(value).alias("x"))
    hot = measure_hot(values, ["sensor"]) if measured else None
    assessed = (
        salted_join(values, known, ["sensor"], "ts", hot=hot, from_files=True)
        .groupBy(*KEYS)
        .agg(F.count("x").alias("n"), F.count_if(violates_limits("x")).alias("issues"))
    )
    return (
        assessed.withColumn("issue_pct", F.try_divide(F.col("issues"), F.col("n")) * 100)
        .withColumn("status", F.when(F.col("n") == 0, "no_valid_data")
                    .when(F.col("issues") > 0, "accuracy_issues").otherwise("ok"))
    )


def accuracy_issues(series: DataFrame, dictionary: DataFrame, value: str = "mean") -> DataFrame:
    """Only the sensors with values outside their limits."""
    return accuracy(series, dictionary, value).where("issues > 0")
