"""Machine tables and readings as DataFrames; sinks."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions import no_nan
from meterline.operators.arrival import FILE, ROW
from meterline.operators.reshape import annotated_to_wide, numbered_sensors, wide_header, wide_lines
from meterline.session import scratch_path, settle


@dataclass(frozen=True)
class Connection:
    """Where the machine tables live; unset fields come from the environment."""

    user: str
    password: str
    host: str
    port: str
    database: str
    subprotocol: str = "postgresql"

    # Environment names of a deployment.
    _ENV = {"user": "DB_USER", "password": "DB_PASS", "host": "DB_IP", "port": "DB_PORT", "database": "DB_NAME"}

    @classmethod
    def from_env(cls, **given) -> "Connection":
        fields = {name: given.get(name) or os.getenv(env) for name, env in cls._ENV.items()}
        unset = [cls._ENV[name] for name, value in fields.items() if not value]
        if unset:
            raise ValueError(f"set {', '.join(unset)} or pass the values")
        return cls(**fields, **{k: v for k, v in given.items() if k == "subprotocol"})

    def options(self) -> dict[str, str]:
        return {"url": f"jdbc:{self.subprotocol}://{self.host}:{self.port}/{self.database}",
                "user": self.user, "password": self.password}


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def jdbc_options(connection: Connection, table: str, lower: str | None = None, upper: str | None = None,
                 partitions: int = 32, partition_column: str = "timestamp") -> dict[str, str]:
    """Options of a parallel JDBC read split on the timestamp column."""
    options = {**connection.options(), "dbtable": table, "fetchsize": "10000"}
    if lower is not None and upper is not None:
        options.update(partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
                       numPartitions=str(partitions))
    return options


def bounds_query(table: str, partition_column: str = "timestamp") -> str:
    """The subquery that asks the database for the range of the split column."""
    return f"(SELECT min({partition_column}) AS lo, max({partition_column}) AS hi FROM {table}) AS bounds"


def tables_query() -> str:
    """The subquery that lists the database's hourly machine tables."""
    return "(SELECT table_name FROM information_schema.tables WHERE lower(table_name) LIKE '%hours%') AS listed"


def _jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def read_machine_table_jdbc(spark: SparkSession, connection: Connection, table: str, **split) -> DataFrame:
    """One machine's wide aggregate table over JDBC, lower-case columns.

    Always read in parallel: without given bounds the database is first asked for them.
    """
    if split.get("lower") is None or split.get("upper") is None:
        column = split.get("partition_column", "timestamp")
        lo, hi = _jdbc(spark, {**connection.options(), "dbtable": bounds_query(table, column)}).first()
        if lo is not None:
            split = {**split, "lower": str(lo), "upper": str(hi)}
    return lower_columns(_jdbc(spark, jdbc_options(connection, table, **split)))


def machine_tables_jdbc(spark: SparkSession, connection: Connection) -> list[str]:
    """Names of the hourly machine tables in the database."""
    listed = _jdbc(spark, {**connection.options(), "dbtable": tables_query()})
    return sorted(r[0] for r in listed.collect())


def read_machine_table(spark: SparkSession, table: str) -> DataFrame:
    """One machine's wide aggregate table from the catalogue, lower-case columns."""
    return lower_columns(spark.table(table))


def read_machine_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return lower_columns(spark.read.format(fmt).load(path))


def machine_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the hourly machine tables in the catalogue."""
    return sorted(t.name for t in spark.catalog.listTables(database) if "hours" in t.name.lower())


def as_readings(rows: DataFrame, machine, sensor, ts, value, ingest_seq=None) -> DataFrame:
    """Any table as (machine, sensor, ts, value, ingest_seq); NaN becomes NULL, ids lower case.

    Arguments are column names or Columns.  Places of a table read by ``with_stored_order`` are kept behind these.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    sequence = col(ingest_seq).cast("bigint") if ingest_seq is not None else F.lit(None).cast("bigint")
    return rows.select(
        col(machine).cast("string").alias("machine"), F.lower(col(sensor).cast("string")).alias("sensor"),
        col(ts).alias("ts"), no_nan(col(value).cast("double")).alias("value"), sequence.alias("ingest_seq"),
        *[c for c in (FILE, ROW) if c in rows.columns])


def write_rollup(rolled: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Native sink: parquet by machine, sorted so that sensor filters skip row groups."""
    (rolled.repartition("machine", F.to_date("bucket_start"))
     .sortWithinPartitions("machine", "sensor", "bucket_start")
     .write.mode(mode).partitionBy("machine").parquet(path))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c != "machine"]
    return stored.select(F.col("machine").cast("string").alias("machine"), *rest)


def write_annotated_csv(annotated: DataFrame, path: str, sensors: list[str] | None = None,
                        mode: str = "overwrite") -> None:
    """Annotated wide export as CSV with a header, written by all tasks."""
    annotated_to_wide(annotated, sensors).write.mode(mode).option("header", True).csv(path)


def write_wide_csv(annotated: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The annotated wide export for any number of sensors: the header in *path*/header, the lines in *path*/rows."""
    numbered = settle(numbered_sensors(annotated), "places")
    wide_header(numbered).write.mode(mode).text(f"{path}/header")
    wide_lines(annotated, numbered).select("value").write.mode(mode).text(f"{path}/rows")


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """(machine, sensor, ts, mean, alarms) of a ``write_wide_csv`` export: the cells that hold something, without a column per sensor.

    Names and machines with a comma or a quote are not read back.
    """
    header = F.split(spark.read.text(f"{path}/header").select("value").scalar(), ",")
    cells = F.split("value", ",", -1)
    pairs = F.transform(F.sequence(F.lit(2), F.size("cells") - 2, F.lit(2)), lambda i: F.struct(
        F.get("names", i).alias("sensor"), F.nullif(F.get("cells", i), F.lit("")).cast("double").alias("mean"),
        F.nullif(F.get("cells", i + 1), F.lit("")).cast("bigint").alias("alarms")))
    return (spark.read.text(f"{path}/rows").select(cells.alias("cells"), header.alias("names"))
            .select(F.col("cells")[0].alias("machine"), F.col("cells")[1].cast("timestamp").alias("ts"), F.inline(pairs))
            .where("mean IS NOT NULL OR alarms IS NOT NULL"))


def csv_round_trip(annotated: DataFrame, sensors: list[str] | None = None) -> DataFrame:
    """The annotated export written to the shared folder and read back with its own schema."""
    wide = annotated_to_wide(annotated, sensors)
    path = scratch_path(wide.sparkSession, "annotated-csv")
    wide.write.option("header", True).csv(path)
    return wide.sparkSession.read.schema(wide.schema).option("header", True).csv(path)
