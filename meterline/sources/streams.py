"""Streams of raw readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions import no_nan
from meterline.schema import READINGS


def kafka_readings(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Readings from JSON messages; needs the public Kafka connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).options(**options).load())
    return parse_json(raw)


def parse_json(messages: DataFrame) -> DataFrame:
    """Readings from a binary or text ``value`` column holding one JSON object each.

    A message that is no reading (no JSON, or without machine, sensor or time) is left out here;
    ``rejected_json`` gives those messages, to be counted or stored beside.
    """
    return (_parsed(messages).where(_IS_READING).select("r.*")
            .withColumn("sensor", F.lower("sensor")).withColumn("value", no_nan("value")))


_IS_READING = "r.machine IS NOT NULL AND r.sensor IS NOT NULL AND r.ts IS NOT NULL"


def _parsed(messages: DataFrame) -> DataFrame:
    text = F.col("value").cast("string")
    return messages.select(text.alias("message"), F.from_json(text, READINGS).alias("r"))


def rejected_json(messages: DataFrame) -> DataFrame:
    """(message): what ``parse_json`` leaves out."""
    return _parsed(messages).where(f"NOT coalesce({_IS_READING}, false)").select("message")


def file_readings(spark: SparkSession, path: str, schema: T.StructType = READINGS, fmt: str = "parquet",
                  name_glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a growing folder; *name_glob* picks files by name."""
    reader = spark.readStream.schema(schema).format(fmt)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
