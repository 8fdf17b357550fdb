"""Wide <-> long reshaping and sensor selection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import no_nan

_SUM_COLUMN = re.compile(r"^sum_(.+)$")


def sensor_columns(wide: DataFrame) -> dict[str, str]:
    """{sensor id: column suffix} of a wide table, read from its schema only.

    The whole suffix after ``sum_`` names the sensor (ids may hold ``_``); one
    leading ``col`` is a column prefix, not part of the id.  Two columns of one id are an error.
    """
    found = [m.group(1) for m in map(_SUM_COLUMN.match, wide.columns) if m]
    named = {suffix.removeprefix("col"): suffix for suffix in found}
    if len(named) < len(found):
        raise ValueError("two columns name the same sensor")
    return named


def wide_to_long(wide: DataFrame, machine, ts: str = "timestamp",
                 flag_meaning: str = "alarms") -> DataFrame:
    """Wide aggregate table -> long rollup (machine, sensor, bucket_start, n, sum_v, n_valid, n_invalid).

    *machine* is a name or a Column.  A sensor without a count column gets NULL
    counts, hence a NULL mean.
    """
    have = set(wide.columns)

    def field(name, kind):
        return F.col(f"`{name}`").cast(kind) if name in have else F.lit(None).cast(kind)

    cells = []
    for sensor, suffix in sensor_columns(wide).items():
        n = field(f"count_{suffix}", "bigint")
        flag = field(f"count_{suffix}_isvalid", "bigint")
        n_valid, n_invalid = (n - flag, flag) if flag_meaning == "alarms" else (flag, n - flag)
        cells.append(F.struct(
            F.lit(sensor).alias("sensor"), n.alias("n"), no_nan(field(f"sum_{suffix}", "double")).alias("sum_v"),
            n_valid.alias("n_valid"), n_invalid.alias("n_invalid")))
    if not cells:
        raise ValueError("no sum_<sensor> column in the table")
    machine = F.lit(machine) if isinstance(machine, str) else machine
    long = wide.select(machine.alias("machine"), F.col(ts).alias("bucket_start"), F.inline(F.array(*cells)))
    return long.select("machine", "sensor", "bucket_start", "n", "sum_v", "n_valid", "n_invalid")


def rollup_to_wide(rollup: DataFrame, sensors: list[str] | None = None,
                   flag_meaning: str = "alarms") -> DataFrame:
    """Long rollup -> one row per (machine, timestamp) with sum_/count_/count_*_isvalid columns.

    A cell without a reading has zero counts and a NULL sum.  Pass *sensors* from the stored
    dictionary: without it Spark first runs a job for the distinct ids, of which a pivot takes
    at most spark.sql.pivotMaxValues (10,000).
    """
    flag = "n_invalid" if flag_meaning == "alarms" else "n_valid"
    pivoted = (rollup.groupBy("machine", F.col("bucket_start").alias("timestamp"))
               .pivot("sensor", sensors)
               .agg(F.first("sum_v").alias("s"), F.first("n").alias("n"), F.first(flag).alias("f")))
    names = {"s": "sum_col{}", "n": "count_col{}", "f": "count_col{}_isvalid"}
    columns = [F.col("machine"), F.col("timestamp")]
    for name in pivoted.columns[2:]:
        sensor, part = name.rsplit("_", 1)
        cell = F.col(f"`{name}`")
        columns.append((cell if part == "s" else F.coalesce(cell, F.lit(0).cast("bigint"))).alias(names[part].format(sensor)))
    return pivoted.select(*columns)


def annotated_to_wide(annotated: DataFrame, sensors: list[str] | None = None) -> DataFrame:
    """One row per (machine, ts): mean as ``<sensor>``, alarms as ``<sensor>_alarms``.

    Pass *sensors* when known; without it Spark first runs a job for the distinct ids.
    """
    pivoted = (annotated.groupBy("machine", "ts").pivot("sensor", sensors)
               .agg(F.first("mean").alias("m"), F.first("alarms").alias("a")))
    columns = [F.col("machine"), F.col("ts")]
    for name in pivoted.columns[2:]:
        sensor, part = name.rsplit("_", 1)
        columns.append(F.col(f"`{name}`").alias(sensor if part == "m" else f"{sensor}_alarms"))
    return pivoted.select(*columns)


def numbered_sensors(annotated: DataFrame) -> DataFrame:
    """(sensor, place): every sensor and its place among the columns of a wide export, from 0 by name."""
    return annotated.select("sensor").distinct().withColumn("place", F.row_number().over(Window.orderBy("sensor")) - 1)


def wide_header(numbered: DataFrame) -> DataFrame:
    """One row: the CSV header of ``wide_lines``."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "sensor"))), lambda s: F.to_csv(
        F.struct(s["sensor"], F.concat(s["sensor"], F.lit("_alarms")))))
    return numbered.agg(F.array_join(F.concat(F.array(F.lit("machine"), F.lit("ts")), names), ",").alias("value"))


def wide_lines(annotated: DataFrame, numbered: DataFrame) -> DataFrame:
    """(machine, ts, value): the CSV lines of ``annotated_to_wide`` for any number of sensors.

    No pivot and no column per sensor: a tick keeps the cells it has, each with its place, and
    places without a cell become runs of commas when the line is put together.
    """
    cells = annotated.join(numbered, "sensor").groupBy("machine", "ts").agg(
        F.array_sort(F.collect_list(F.struct("place", F.to_csv(F.struct("mean", "alarms")).alias("text")))).alias("cells"))
    width = numbered.agg(F.count(F.lit(1)).alias("width"))
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["place"]).otherwise(F.lit(-1))
    skipped = lambda gap: F.repeat(F.lit(","), gap.cast("int"))
    body = F.array_join(F.transform("cells", lambda c, i: F.concat(
        skipped(2 * (c["place"] - before(i) - 1) + 1), c["text"])), "")
    last = F.get("cells", F.size("cells") - 1)["place"]
    return cells.select("machine", "ts", F.concat(
        F.to_csv(F.struct("machine", "ts")), body, skipped(2 * (width.select("width").scalar() - 1 - last))).alias("value"))


def select_sensors(series: DataFrame, sensors: list[str]) -> DataFrame:
    """Only the chosen sensors.  Reaches a stored table's scan as a pushed filter; on readings still
    to be lower-cased (``as_readings``) it is applied right after the scan."""
    return series.where(F.col("sensor").isin(*[s.lower() for s in sensors]))


def combine_means_and_alarms(means: DataFrame, alarms: DataFrame) -> DataFrame:
    """Full outer join of separately stored means and alarms on (machine, sensor, ts)."""
    return means.join(alarms, ["machine", "sensor", "ts"], "full_outer")
