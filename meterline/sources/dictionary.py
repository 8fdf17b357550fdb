"""Sensor dictionary reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.schema import DICTIONARY


def normalise(dictionary: DataFrame) -> DataFrame:
    """Header to lower case with underscores, tags to lower case."""
    renamed = dictionary.toDF(*[c.strip().lower().replace(" ", "_") for c in dictionary.columns])
    return renamed.withColumn("tag", F.lower("tag"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary CSV: columns by their header in any order, all as text, description blanks kept.

    Further columns are left out; a missing one is an error.
    """
    read = normalise(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False)
                     .option("ignoreTrailingWhiteSpace", False).csv(path))
    missing = [name for name in DICTIONARY.names if name not in read.columns]
    if missing:
        raise ValueError(f"the dictionary lacks {', '.join(missing)}")
    return read.select(*DICTIONARY.names)
