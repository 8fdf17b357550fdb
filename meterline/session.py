"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_workdir: str | None = None


def build_session(app_name: str = "meterline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for; *conf* wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Stream state of many sensors and buckets stays off the heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workdir(spark: SparkSession) -> str:
    """Shared folder for written tables and stream state.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder: on a cluster no other host could read it.
    """
    global _local_workdir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_workdir is None:
        _local_workdir = tempfile.mkdtemp(prefix="meterline-")
    return _local_workdir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder.

    Everything of one application lies under one folder, to be removed when it has ended.
    """
    return f"{workdir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write *df* as parquet in the shared folder and read it back.

    For tables that several branches of one plan read (a rollup below a grid and
    a report): the raw scan then runs once, lost executors cost nothing, and each
    branch still prunes columns and gets real size statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
