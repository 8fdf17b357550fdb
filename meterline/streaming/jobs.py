"""Structured Streaming forms of the rollup and of the checks on it.

State and output live below paths the caller names (on a cluster: the shared
folder).  Every ``foreachBatch`` sink overwrites the folder of its batch id, so a
batch that runs again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from meterline.operators.rollup import rollup_measures, with_validity
from meterline.schema import QualityConfig
from meterline.session import settle

KEYS = ["machine", "sensor"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_KEYS = [*KEYS, "bucket_start"]


def event_time(readings: DataFrame) -> DataFrame:
    """Zoned event time: watermarks refuse zoneless timestamps."""
    return readings.withColumn("ts", F.col("ts").cast("timestamp"))


def drop_repeats(readings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One reading per (machine, sensor, ts) as long as copies arrive within *lateness*."""
    return event_time(readings).withWatermark("ts", lateness).dropDuplicatesWithinWatermark([*KEYS, "ts"])


def stream_rollup(readings: DataFrame, dictionary: DataFrame | None = None, bucket: str = "1 hour",
                  lateness: str = "1 hour") -> DataFrame:
    """The batch rollup over a stream; rows later than *lateness* are dropped by the watermark."""
    timed = event_time(readings).withWatermark("ts", lateness)
    return (with_validity(timed, dictionary).groupBy(*KEYS, F.window("ts", bucket).alias("w"))
            .agg(*rollup_measures())
            .select(*KEYS, F.col("w.start").alias("bucket_start"), "n", "sum_v", "n_valid", "n_invalid"))


def start_append(result: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Final rows only, to a parquet table."""
    writer = (result.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batch_writer(path: str, run: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        _write_log(batch, path, run, batch_id)
    return write


def _write_log(batch: DataFrame, path: str, run: str, batch_id: int) -> None:
    """One batch of an upsert log, by day: later reads open the days they ask for only."""
    (batch.withColumn("day", F.to_date("bucket_start")).write.mode("overwrite").partitionBy("day")
     .parquet(f"{path}/run={run}/batch_id={batch_id}"))


def start_upsert(result: DataFrame, path: str, checkpoint: str, available_now: bool = True, run: str = "0") -> StreamingQuery:
    """Changed rows of every batch, one folder per batch and day; ``latest`` reads the current table.

    Batch ids start anew with a new checkpoint: give such a start a greater *run* (a text that sorts
    behind the earlier ones, such as a date), so that its rows win over those written before.
    """
    writer = (result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
              .foreachBatch(_batch_writer(path, run)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str] = BUCKET_KEYS, days: list | None = None) -> DataFrame:
    """Current rows of an upsert folder: per key the one of the newest batch of the newest run.

    With *days* (dates), only files of those days are read, however long the log has grown.
    """
    log = spark.read.parquet(path)
    if days is not None:
        log = log.where(F.col("day").isin(*days))
    measures = [c for c in log.columns if c not in (*keys, "run", "batch_id", "day")]
    age = F.struct(F.col("run").cast("string"), F.col("batch_id").cast("bigint"))
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*measures), age).alias("m"))
    return newest.select(*keys, "m.*")


def compact(spark: SparkSession, path: str, target: str, keys: list[str] = BUCKET_KEYS) -> None:
    """The current rows of an upsert folder as one plain table at *target*."""
    latest(spark, path, keys).write.mode("overwrite").parquet(target)


def fold_closed_days(spark: SparkSession, path: str, target: str, before, keys: list[str] = BUCKET_KEYS) -> int:
    """Move the days before *before* (a date) from an upsert log into the table at *target*, by day; the number of days moved.

    The table's day folders are written first and the log's files deleted after: a run that ends in between
    is simply repeated, with the same result.  A day that comes again, with a newer run, replaces the rows it holds.
    The days must be closed: the stream's watermark has passed them.
    """
    days = sorted(r.day for r in _log_days(spark, path) if r.day < before)
    if not days:
        return 0
    rows = latest(spark, path, keys, days).withColumn("day", F.to_date("bucket_start"))
    try:
        stored = spark.read.parquet(target).where(F.col("day").isin(*days)).select(*rows.columns)
        rows = rows.unionByName(stored.join(rows.select(*keys), keys, "left_anti"))
    except AnalysisException:  # the first fold makes the table
        pass
    # Written elsewhere first, as a folder cannot be replaced while it is read.
    (settle(rows, "folded").repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(target))
    for day in days:
        _delete_matching(spark, f"{path}/run=*/batch_id=*/day={day}")
    return len(days)


def folded(spark: SparkSession, path: str, target: str, keys: list[str] = BUCKET_KEYS) -> DataFrame:
    """The current rows: those of the log, and the folded ones it does not hold."""
    stored = spark.read.parquet(target).drop("day")
    if not _log_days(spark, path):
        return stored
    newer = latest(spark, path, keys)
    return newer.unionByName(stored.join(newer.select(*keys), keys, "left_anti").select(*newer.columns))


def _log_days(spark: SparkSession, path: str) -> list:
    """The days of an upsert log, from its folder names."""
    try:
        return spark.read.parquet(path).select("day").distinct().collect()
    except AnalysisException:  # all of it is folded
        return []


def _delete_matching(spark: SparkSession, pattern: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(where) or []:
        files.delete(found.getPath(), True)


def stream_alarms(readings: DataFrame, dictionary: DataFrame, bucket: str = "1 hour",
                  lateness: str = "1 hour", threshold: int = 1) -> DataFrame:
    """(machine, sensor, ts, mean, alarms) of buckets with *threshold* or more readings outside the limits."""
    rolled = stream_rollup(readings, dictionary, bucket, lateness)
    return rolled.where(F.col("n_invalid") >= threshold).select(
        *KEYS, F.col("bucket_start").alias("ts"), F.try_divide("sum_v", "n").alias("mean"),
        F.col("n_invalid").alias("alarms"))


def stream_gaps(readings: DataFrame, config: QualityConfig, lateness: str = "1 hour") -> DataFrame:
    """Runs of under-filled buckets, emitted once closed: (machine, sensor, gap_start, gap_end, n_buckets).

    A session merges bad buckets one bucket length apart.  Buckets without any reading make no
    stream row: use ``start_gap_watch`` where sensors may fall silent.
    """
    timed = event_time(readings).withWatermark("ts", lateness)
    short = (
        timed.groupBy(*KEYS, F.window("ts", config.bucket).alias("w")).agg(F.count("value").alias("n"))
        .where(F.col("n") < config.agg_freq)
        .select(*KEYS, F.window_time("w").alias("closed_at"), F.col("w.start").alias("bucket_start"))
    )
    return (
        short.groupBy(*KEYS, F.session_window("closed_at", config.bucket).alias("s"))
        .agg(F.min("bucket_start").alias("gap_start"), F.max("bucket_start").alias("gap_end"),
             F.count(F.lit(1)).alias("n_buckets"))
        .select(*KEYS, "gap_start", "gap_end", "n_buckets")
    )


def gap_events(rolled: DataFrame, sensors: DataFrame, config: QualityConfig) -> DataFrame:
    """Periods of under-filled or silent buckets as they open and close: (machine, sensor, gap_start, gap_end, n_buckets, event).

    *rolled* is a stream rollup in append mode, *sensors* the expected (machine, sensor, since) rows: from the
    bucket that starts at *since* (a timestamp) a sensor owes a bucket each bucket length, whether its machine
    is alive or not.  A sensor that was not expected is watched from its first reading.

    Each sensor has one timer, at the end of the bucket it owes next; a closed bucket moves it on, and when the
    watermark reaches it the buckets up to there are silent, however many, in one step.  So the state of a sensor
    is three numbers however long the job runs, a dead one costs a timer a batch, and nothing written before is read.
    A period has an "open" row when its first bucket is missed, and a "closed" row with its full length when a full
    bucket ends it.  Late rows are dropped by the rollup's watermark.
    """
    from meterline.streaming.gaps import EVENTS, GapProcessor

    known = sensors.select(*KEYS, F.unix_timestamp(F.col("since").cast("timestamp")).alias("since_s")).distinct()
    return (rolled.select(*BUCKET_KEYS, "n").groupBy(*KEYS)
            .transformWithState(GapProcessor(config.bucket_s, config.agg_freq), EVENTS, "append", "eventTime", initialState=known.groupBy(*KEYS)))


def start_gap_watch(rolled: DataFrame, sensors: DataFrame, config: QualityConfig, path: str, checkpoint: str,
                    available_now: bool = True, run: str = "0") -> StreamingQuery:
    """``gap_events`` into a folder per run and batch; ``closed_gaps`` and ``open_gaps`` read them.

    A start with a new checkpoint knows nothing of the periods before it: give it a *since* and a greater *run*.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    conf, name = rolled.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)  # timers need it; a query keeps the settings it is started with
    try:
        writer = (gap_events(rolled, sensors, config).writeStream.outputMode("append")
                  .option("checkpointLocation", checkpoint).foreachBatch(write))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)


def closed_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(machine, sensor, gap_start, gap_end, n_buckets): periods of short or silent buckets that have ended."""
    return spark.read.parquet(path).where("event = 'closed'").select(*KEYS, "gap_start", "gap_end", "n_buckets")


def open_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(machine, sensor, gap_start): periods that go on, silent sensors and dead machines among them."""
    events = spark.read.parquet(path).groupBy(*KEYS, "gap_start").agg(F.bool_or(F.col("event") == "closed").alias("ended"))
    return events.where("NOT ended").select(*KEYS, "gap_start")


def silent_buckets(closed: DataFrame, sensors: DataFrame) -> DataFrame:
    """(machine, sensor, bucket_start) where a known sensor sent nothing in a closed bucket of its machine.

    *closed* is a batch of final rollup rows, *sensors* the expected (machine, sensor) rows.
    """
    seen = closed.select("machine", "bucket_start").distinct()
    expected = seen.join(sensors.select(*KEYS).distinct(), "machine")
    return expected.join(closed.select(*BUCKET_KEYS), BUCKET_KEYS, "left_anti").select(*BUCKET_KEYS)


def _start_watch(rolled: DataFrame, mode: str, check, table: str, path: str, checkpoint: str,
                 available_now: bool, run: str) -> StreamingQuery:
    """Per batch: its rows into *table*, then ``check(spark, rows read back)`` into *path*, both by run and batch.

    The stateful plan runs once, for the write; the check reads the written rows.
    """
    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write_log(batch, table, run, batch_id)
        rows = spark.read.schema(batch.schema).parquet(f"{table}/run={run}/batch_id={batch_id}")
        if not rows.isEmpty():
            check(spark, rows).write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")

    writer = rolled.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(watch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_silence_watch(rolled: DataFrame, sensors: DataFrame, table: str, path: str, checkpoint: str,
                        available_now: bool = True, run: str = "0") -> StreamingQuery:
    """``silent_buckets`` of every batch of closed buckets to *path*; the closed buckets themselves to *table*.

    As for ``start_upsert``, a start with a new checkpoint needs a greater *run*.
    """
    return _start_watch(rolled, "append", lambda spark, closed: silent_buckets(closed, sensors),
                        table, path, checkpoint, available_now, run)


def start_quality_watch(rolled: DataFrame, dictionary: DataFrame, config: QualityConfig, table: str, path: str,
                        checkpoint: str, available_now: bool = True, run: str = "0") -> StreamingQuery:
    """Quality report per micro-batch, over the buckets the batch changed.

    The upsert log at *table* grows by the batch first; the report then covers the current
    rows of the touched buckets, so a bucket that changes twice is judged on its full content.
    Only the log files of the touched days are read.  ``history.start_history_watch`` reports on the whole history
    instead.  As for ``start_upsert``, a start with a new checkpoint needs a greater *run*.
    """
    from meterline.plans.reports import quality_report

    def report(spark: SparkSession, rows: DataFrame) -> DataFrame:
        touched = rows.select("machine", "bucket_start").distinct()
        days = [r.day for r in rows.select(F.to_date("bucket_start").alias("day")).distinct().collect()]
        current = latest(spark, table, days=days).join(touched, ["machine", "bucket_start"], "left_semi")
        return quality_report(settle(current, "touched"), dictionary, config)

    return _start_watch(rolled, "update", report, table, path, checkpoint, available_now, run)


class LateRows(StreamingQueryListener):
    """Running totals of rows dropped by the watermark, one number a query however long it runs.

    To be added before the query starts: ``spark.streams.addListener(late)``; ``late.total(query)`` then counts this run of
    the query from its first batch on.  Progress arrives shortly after a batch ends.
    """

    def __init__(self):
        self._totals: dict[str, int] = {}

    def onQueryStarted(self, event):
        self._totals[str(event.runId)] = 0

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        self._totals[run] = self._totals.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def total(self, query: StreamingQuery) -> int:
        return self._totals.get(str(query.runId), 0)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped in the batches that the query's progress still lists, the last hundred; ``LateRows`` counts all."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
