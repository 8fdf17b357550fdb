"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.schema import LOWER_LIMIT_TYPES, UPPER_LIMIT_TYPES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c) -> Column:
    """NULL instead of NaN: Spark orders NaN above every number."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def seconds_between(earlier, later) -> Column:
    """Whole seconds from one timestamp to another (zoned or zoneless)."""
    return F.timestamp_diff("SECOND", _col(earlier), _col(later))


def limit_columns(low="low_threshold", high="high_threshold", kind="threshold_type"):
    """(low_limit, high_limit) that apply for the declared threshold type."""
    kind = _col(kind)
    return (
        F.when(kind.isin(*LOWER_LIMIT_TYPES), _col(low)),
        F.when(kind.isin(*UPPER_LIMIT_TYPES), _col(high)),
    )


def violates_limits(value, low_limit="low_limit", high_limit="high_limit") -> Column:
    """True outside the limits; an absent limit or value never violates."""
    value = _col(value)
    below = F.coalesce(value < _col(low_limit), F.lit(False))
    above = F.coalesce(value > _col(high_limit), F.lit(False))
    return below | above


def plot_label(sensor="sensor", description="tag_description") -> Column:
    """``<description> (<sensor>)``, or the bare id without a description."""
    sensor = _col(sensor)
    return F.coalesce(F.concat(_col(description), F.lit(" ("), sensor, F.lit(")")), sensor)


def digits_only(c) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")
