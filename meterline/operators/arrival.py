"""Order of arrival: by sequence number, or by the place a row has in the stored files.

Both ways end in the same numbers.  Rows reach a task in order; the task compares neighbours of a machine as they
pass, in numpy, and leaves one summary for each run of a machine's rows: how often time went back or stood still,
and the run's ends.  Summaries, a few for each machine and task, are then put in order and compared at their seams.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a row's place in its table.
FILE, ROW = "stored_file", "stored_row"
_RUNS = ("machine string, file string, first long, first_ts long, last_ts long, n_rows long, unplaced long, "
         "backward long, equal long")


def with_stored_order(table: DataFrame) -> DataFrame:
    """A table just read from parquet files, with each row's file and its number in it."""
    return table.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _runs(batches: Iterator) -> Iterator:
    """Summaries of runs; *batches* have (machine, file, place, ts), each task's rows in order within a file.

    A run ends where the file changes or the place goes back, as at the start of another split.
    """
    import numpy as np
    import pyarrow as pa

    open_runs: dict = {}  # machine -> [file, first, first_ts, last place, last_ts, backward, equal]
    counts: dict = {}  # machine -> [rows, rows without a place]
    done: list[tuple] = []

    def close(machine, run) -> None:
        file, first, first_ts, _, last_ts, backward, equal = run
        done.append((machine, file, first, first_ts, last_ts, 0, 0, backward, equal))

    def sent() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * 9
        types = [pa.string(), pa.string()] + [pa.int64()] * 7
        names = [c.split()[0] for c in _RUNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        coded, files = (batch.column(c).dictionary_encode(null_encoding="encode") for c in ("machine", "file"))
        names, file_names = coded.dictionary.to_pylist(), files.dictionary.to_pylist()
        code, file = coded.indices.to_numpy(), files.indices.to_numpy()
        placed = batch.column("place").is_valid().to_numpy(zero_copy_only=False)
        timed = placed & batch.column("ts").is_valid().to_numpy(zero_copy_only=False)
        for i, (n, m) in enumerate(zip(np.bincount(code, minlength=len(names)).tolist(), np.bincount(code[~placed], minlength=len(names)).tolist())):
            own = counts.setdefault(names[i], [0, 0])
            own[0] += n
            own[1] += m
        keep = np.flatnonzero(timed)
        keep = keep[np.argsort(code[keep], kind="stable")]
        if not len(keep):
            continue
        code, file = code[keep], file[keep]
        place = batch.column("place").fill_null(0).to_numpy()[keep]
        ts = batch.column("ts").cast(pa.int64()).fill_null(0).to_numpy()[keep]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (file[1:] != file[:-1]) | (place[1:] < place[:-1])])
        step = np.concatenate([[False], ts[1:] < ts[:-1]]) & ~new, np.concatenate([[False], ts[1:] == ts[:-1]]) & ~new
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(ts)) - 1
        backward, equal = (np.add.reduceat(x.astype(np.int64), start) for x in step)
        for c, f, p0, t0, p1, t1, b, e in zip(*(x.tolist() for x in (code[start], file[start], place[start], ts[start], place[last], ts[last], backward, equal))):
            machine, name = names[c], file_names[f]
            run = open_runs.get(machine)
            if run is not None and run[0] == name and p0 >= run[3]:
                run[5] += b + (t0 < run[4])
                run[6] += e + (t0 == run[4])
                run[3], run[4] = p1, t1
            else:
                if run is not None:
                    close(machine, run)
                open_runs[machine] = [name, p0, t0, p1, t1, b, e]
        if len(done) > 10_000:
            yield sent()
            done.clear()
    for machine, run in open_runs.items():
        close(machine, run)
    done.extend((machine, None, None, None, None, n, m, 0, 0) for machine, (n, m) in counts.items())
    yield sent()


def _totals(runs: DataFrame) -> DataFrame:
    """(machine, total_rows, unplaced, n_backward, n_equal) of run summaries."""
    before = Window.partitionBy("machine").orderBy("file", "first", "first_ts").rowsBetween(Window.unboundedPreceding, -1)
    seams = runs.withColumn("prev", F.last("last_ts", ignorenulls=True).over(before))
    return seams.groupBy("machine").agg(
        F.sum("n_rows").alias("total_rows"), F.sum("unplaced").alias("unplaced"),
        (F.sum("backward") + F.count_if(F.col("first_ts") < F.col("prev"))).alias("n_backward"),
        (F.sum("equal") + F.count_if(F.col("first_ts") == F.col("prev"))).alias("n_equal"))


def _stored(readings: DataFrame) -> DataFrame:
    rows = readings.select("machine", F.col(FILE).alias("file"), F.col(ROW).alias("place"), "ts")
    return _totals(rows.mapInArrow(_runs, _RUNS))


def _numbered(readings: DataFrame) -> DataFrame:
    # Ranges are cut by rows, through a machine, a number and a timestamp alike, so a hot machine, dense numbers
    # or one number on every row give tasks of one size.  Equal numbers are taken in the order of their timestamps.
    rows = readings.select("machine", F.lit("").alias("file"), F.col("ingest_seq").cast("long").alias("place"), "ts")
    key = ["machine", "place", "ts"]
    return _totals(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_runs, _RUNS))


def timestamp_order(readings: DataFrame, by: str = "number") -> DataFrame:
    """(machine, total_rows, n_backward, n_equal, monotonic, status) of rows whose timestamp is before, or equal to, that of the row that arrived before.

    *by* "number" takes ``ingest_seq`` for the order of arrival, and of equal numbers the earlier timestamp first.
    *by* "stored" takes the place in the table's files (``with_stored_order``): files by their path, rows as they
    lie in them.  That needs no number, no sort and no shuffle of rows: tasks read their splits and shuffle run
    summaries only.  Rows without a timestamp stand in nobody's way: they are counted in total_rows and skipped.
    A machine with rows that lack a number has no order by number: where the stored places are columns of
    *readings* they are used for it, else its status is ``not_assessable`` and the counts are NULL.
    """
    if by not in ("number", "stored"):
        raise ValueError(f"unknown order {by!r}: number or stored")
    if dict(readings.dtypes)["ts"] == "date":
        readings = readings.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    placed = FILE in readings.columns and ROW in readings.columns
    if by == "stored" and not placed:
        raise ValueError("read the table through with_stored_order first")
    counted = ["n_backward", "n_equal"]
    if by == "stored":
        totals = _stored(readings).withColumn("known", F.col("unplaced") == 0)
    else:
        totals = _numbered(readings).withColumn("known", F.col("unplaced") == 0)
        if placed:
            other = _stored(readings).select(F.col("machine").alias("m"), *[F.col(c).alias(f"stored_{c}") for c in counted], (F.col("unplaced") == 0).alias("stored_known"))
            joined = totals.join(other, F.col("machine").eqNullSafe(F.col("m")))
            totals = joined.select("machine", "total_rows", *[F.when(F.col("known"), F.col(c)).otherwise(F.col(f"stored_{c}")).alias(c) for c in counted],
                                   (F.col("known") | F.col("stored_known")).alias("known"))
    monotonic = F.col("n_backward") == 0
    return (totals.select("machine", "total_rows", *[F.when(F.col("known"), F.col(c)).alias(c) for c in counted])
            .withColumn("monotonic", monotonic)
            .withColumn("status", F.when(F.col("monotonic").isNull(), "not_assessable").when(F.col("monotonic"), "ok").otherwise("out_of_order")))
