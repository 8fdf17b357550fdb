"""Sensor dictionary: filters, limits and metadata lint."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import limit_columns

# Unit spellings that mean the same unit as another one.
UNIT_ALIASES = {"kgf/cm2": "kg/cm2"}


def limits(dictionary: DataFrame) -> DataFrame:
    """One row per lower-cased tag with the numeric limits its type uses.

    A repeated tag keeps its smallest row, so readings never multiply in a join; if its rows
    ask for different limits, none apply and its sensor is not assessed.  ``metadata_lint`` reports both.
    """
    low, high = limit_columns(
        F.expr("try_cast(low_threshold AS DOUBLE)"), F.expr("try_cast(high_threshold AS DOUBLE)"))
    picked = (
        dictionary.where(F.col("tag").isNotNull())
        .select(
            F.lower("tag").alias("sensor"),
            F.struct("tag_description", "machine_group", "threshold_type", "aggregation_rule",
                     low.alias("low_limit"), high.alias("high_limit")).alias("d"))
        .groupBy("sensor").agg(F.min("d").alias("d"), _conflict("d.low_limit", "d.high_limit").alias("conflict"))
    )
    told = [F.col(f"d.{name}").alias(name) for name in ("tag_description", "machine_group", "threshold_type", "aggregation_rule")]
    return picked.select("sensor", *told, *[F.when(~F.col("conflict"), F.col(f"d.{name}")).alias(name) for name in ("low_limit", "high_limit")])


def _conflict(low, high):
    """Aggregate: whether the rows of a tag ask for different limits."""
    pair = F.struct(low, high)
    return ~F.min(pair).eqNullSafe(F.max(pair))


def present_tags(dictionary: DataFrame, sensors: DataFrame) -> DataFrame:
    """Dictionary rows whose tag occurs among *sensors*."""
    keys = sensors.select(F.lower("sensor").alias("tag")).distinct()
    return dictionary.withColumn("tag", F.lower("tag")).join(keys, "tag", "left_semi")


def machine_tags(dictionary: DataFrame, group: str, contains: bool = False) -> DataFrame:
    """Dictionary rows of one machine group.

    ``contains=True`` matches case-insensitively and ignores the first letter of
    the group name; the default equality prunes at the scan.
    """
    if contains:
        return dictionary.where(F.col("machine_group").rlike("(?i)" + re.escape(group[1:])))
    return dictionary.where(F.col("machine_group") == group)


def machine_groups(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("machine_group").distinct()


def sensors_per_group(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("machine_group").agg(F.count(F.lit(1)).alias("sensors"))


def labels(sensors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every sensor with its display label, with or without metadata."""
    from meterline.functions import plot_label

    described = limits(dictionary).select("sensor", "tag_description")
    return (sensors.join(described, "sensor", "left")
            .withColumn("label", plot_label()).drop("tag_description"))


def _threshold_issues(dictionary: DataFrame) -> DataFrame:
    low_raw, high_raw = limit_columns()
    low = F.expr("try_cast(low_threshold AS DOUBLE)")
    high = F.expr("try_cast(high_threshold AS DOUBLE)")
    uses_low, uses_high = limit_columns(F.lit(True), F.lit(True))
    malformed = ((F.col("low_threshold").isNotNull() & low.isNull())
                 | (F.col("high_threshold").isNotNull() & high.isNull()))
    checks = {
        "threshold_malformed": malformed,
        "low_threshold_missing": uses_low & low_raw.isNull(),
        "high_threshold_missing": uses_high & high_raw.isNull(),
        "low_above_high": low > high,
        "not_assessed": F.col("threshold_type").isNull(),
        "untrimmed_text": (F.trim("tag_description") != F.col("tag_description"))
        | (F.trim("engineering_units") != F.col("engineering_units")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return dictionary.select(F.lower("tag").alias("sensor"), F.explode(found).alias("issue"))


def _unit_issues(dictionary: DataFrame) -> DataFrame:
    """Units spelled otherwise than the commonest spelling of the same unit."""
    folded = F.lower(F.trim("engineering_units"))
    for alias, name in UNIT_ALIASES.items():
        folded = F.when(folded == alias, F.lit(name)).otherwise(folded)
    rows = dictionary.where(F.col("engineering_units").isNotNull()).select(
        F.lower("tag").alias("sensor"), F.col("engineering_units").alias("unit"), folded.alias("folded"))
    spellings = rows.groupBy("folded", "unit").agg(F.count(F.lit(1)).alias("uses"))
    commonest = spellings.groupBy("folded").agg(
        F.min(F.struct((-F.col("uses")).alias("order"), F.col("unit").alias("spelling"))).alias("c"))
    odd = (spellings.join(commonest, "folded").where(F.col("unit") != F.col("c.spelling"))
           .select("unit"))
    return rows.join(odd, "unit", "left_semi").select("sensor", F.lit("unit_spelling").alias("issue"))


def metadata_lint(dictionary: DataFrame) -> DataFrame:
    """(sensor, issue): malformed, missing or inverted limits, repeated tags and such whose rows ask
    for different limits, odd unit spellings, untrimmed text, sensors that cannot be assessed."""
    low, high = limit_columns(
        F.expr("try_cast(low_threshold AS DOUBLE)"), F.expr("try_cast(high_threshold AS DOUBLE)"))
    issues = F.array(F.lit("duplicate_tag"), F.when(F.col("conflict"), F.lit("conflicting_limits")))
    repeated = (dictionary.groupBy(F.lower("tag").alias("sensor"))
                .agg(F.count(F.lit(1)).alias("uses"), _conflict(low, high).alias("conflict")).where("uses > 1")
                .select("sensor", F.explode(F.array_compact(issues)).alias("issue")))
    return (_threshold_issues(dictionary).unionByName(_unit_issues(dictionary))
            .distinct().unionByName(repeated))


def unmatched_sensors(readings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(sensor, issue): sensors without metadata and metadata without data."""
    with_data = readings.select(F.lower("sensor").alias("sensor")).distinct()
    with_meta = dictionary.select(F.lower("tag").alias("sensor")).distinct()
    no_meta = with_data.join(with_meta, "sensor", "left_anti").withColumn("issue", F.lit("no_metadata"))
    no_data = with_meta.join(with_data, "sensor", "left_anti").withColumn("issue", F.lit("no_data"))
    return no_meta.unionByName(no_data)
