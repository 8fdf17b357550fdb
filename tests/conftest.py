import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("meterline-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.default.parallelism", "2").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, tuples...) -> DataFrame"""
    def make(schema, *values):
        return spark.createDataFrame(list(values), schema)
    return make


def at(hour: float, day: int = 1):
    from datetime import datetime, timedelta

    return datetime(2024, 1, day) + timedelta(hours=hour)


def found(df, *columns):
    """Sorted tuples of the named columns, NULLs first."""
    taken = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(taken, key=lambda t: tuple((v is not None, v) for v in t))
