"""A stored rollup that grows batch by batch, each batch folded in exactly once.

Below one path lie ``data/part=.../machine=.../day=...`` and ``record/version=...``.  A fold writes the rollup of its
batch as a part of its own and then a new version of the record, which lists the batches folded so far and the part
that holds each.  Only what the record lists is read: a fold that fails before the record is written leaves nothing
behind that counts, and is repeated with the same result; one whose batch is recorded does nothing.  ``compact``
merges the parts the same way.  One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.operators.rollup import KEYS, rollup, untimed

_RECORD = "batch string, part string, readings long, untimed long"


def record(spark: SparkSession, path: str) -> DataFrame:
    """(version, batch, part, readings, untimed) of the newest record, one row a folded batch; empty before the first."""
    try:
        versions = spark.read.schema(f"{_RECORD}, version long").parquet(f"{path}/record")
    except AnalysisException:  # nothing is folded yet
        return spark.createDataFrame([], f"{_RECORD}, version long")
    return versions.where(F.col("version") == (versions.agg(F.max("version")).first()[0] or 0))


def _commit(rows: DataFrame, path: str, version: int) -> None:
    rows.select("batch", "part", "readings", "untimed").coalesce(1).write.mode("overwrite").parquet(f"{path}/record/version={version}")


def _write_part(rolled: DataFrame, path: str, part: str) -> None:
    day = F.to_date("bucket_start")
    (rolled.withColumn("day", day).repartition("machine", "day").sortWithinPartitions("machine", "day", "sensor", "bucket_start")
     .write.mode("overwrite").partitionBy("machine", "day").parquet(f"{path}/data/part={part}"))


def fold(readings: DataFrame, dictionary: DataFrame | None, path: str, batch: str, bucket: str = "1 hour") -> bool:
    """Fold the readings of *batch* (a name: a day, a load number) into the rollup at *path*; whether there was anything to do.

    Buckets that an earlier batch holds as well add up.  Readings without a timestamp are counted in the record.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    spark = readings.sparkSession
    known = record(spark, path)
    if not known.where(F.col("batch") == batch).isEmpty():
        return False
    _write_part(rollup(readings, dictionary, bucket), path, f"b-{batch}")
    lost = untimed(readings).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("readings"), F.coalesce(F.sum("untimed"), F.lit(0)).alias("untimed"))
    added = lost.select(F.lit(batch).alias("batch"), F.lit(f"b-{batch}").alias("part"), "readings", "untimed")
    _commit(known.select(*added.columns).unionByName(added), path, _newest(known) + 1)
    return True


def _newest(known: DataFrame) -> int:
    return known.agg(F.max("version")).first()[0] or 0


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """The rollup of all folded batches (machine, sensor, bucket_start, n, sum_v, n_valid, n_invalid); filters on ``day`` and machine prune folders."""
    parts = [r.part for r in record(spark, path).select("part").distinct().collect()]  # one a batch since the last compaction
    source, folders = spark.read.option("basePath", f"{path}/data"), [f"{path}/data/part={p}" for p in parts]
    # Folder names that look like numbers are names all the same: "01" is not 1.
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("machine", "part") else f for f in source.parquet(*folders).schema])
    stored = source.schema(schema).parquet(*folders)
    return stored.groupBy(*KEYS, "day", "bucket_start").agg(*[F.sum(c).alias(c) for c in ("n", "sum_v", "n_valid", "n_invalid")])


def compact(spark: SparkSession, path: str) -> None:
    """All parts as one; the record keeps every batch, so a batch that comes again is still known.

    Parts that no record lists are deleted last: those merged just now, and what failed folds left.
    """
    known = record(spark, path)
    version = _newest(known) + 1
    if known.isEmpty():
        return
    part = f"c-{version}"
    _write_part(read_folded(spark, path).drop("day"), path, part)
    _commit(known.withColumn("part", F.lit(part)), path, version)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(hadoop):
        if found.getPath().getName() != f"part={part}":
            files.delete(found.getPath(), True)
