"""Schemas and job parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("machine", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("ingest_seq", T.LongType()),
])

ROLLUP_MEASURES = ("n", "sum_v", "n_valid", "n_invalid")

# Limits stay text at the edge: a malformed one ("1,799,999") must reach the
# metadata lint instead of failing the read.
DICTIONARY = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("tag_description", T.StringType()),
    T.StructField("machine_group", T.StringType()),
    T.StructField("low_threshold", T.StringType()),
    T.StructField("high_threshold", T.StringType()),
    T.StructField("threshold_type", T.StringType()),
    T.StructField("aggregation_rule", T.StringType()),
    T.StructField("engineering_units", T.StringType()),
    T.StructField("category", T.StringType()),
])

# Fixed values of the dictionary format.
LOWER_LIMIT_TYPES = ("Down", "Up/Down")
UPPER_LIMIT_TYPES = ("Up", "Up/Down")
AGGREGATION_RULES = ("min", "max", "avg")

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def duration_seconds(text: str) -> int:
    """Seconds in an interval literal such as ``1 hour`` or ``30 minutes``."""
    match = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", text.lower())
    if not match or match.group(2) not in _UNIT_SECONDS:
        raise ValueError(f"not a fixed-length interval: {text!r}")
    return int(match.group(1)) * _UNIT_SECONDS[match.group(2)]


@dataclass(frozen=True)
class QualityConfig:
    """Parameters of one assessment.

    expected_mode  ``span``: expected readings come from last - first bucket start
                   (one bucket short); ``buckets``: every bucket of the span counts.
    gap_mode       ``bucket``: bad buckets merge while one bucket length apart;
                   ``product``: while agg_freq * orig_freq seconds apart.
    flag_meaning   what ``count_*_isvalid`` of a wide table holds: ``alarms`` or ``valid``.
    """

    orig_freq_s: int = 10
    bucket: str = "1 hour"
    completeness_threshold: float = 90.0
    strong_correlation: float = 0.7
    zscore_k: float = 3.0
    anomaly_k: float = 2.0
    alarm_threshold: int = 1
    rolling_rows: int = 24
    season_period: int = 24
    expected_mode: str = "span"
    gap_mode: str = "bucket"
    flag_meaning: str = "alarms"
    null_is_gap: bool = False

    def __post_init__(self):
        if self.expected_mode not in ("span", "buckets"):
            raise ValueError("expected_mode is 'span' or 'buckets'")
        if self.gap_mode not in ("bucket", "product"):
            raise ValueError("gap_mode is 'bucket' or 'product'")
        if self.flag_meaning not in ("alarms", "valid"):
            raise ValueError("flag_meaning is 'alarms' or 'valid'")

    @property
    def bucket_s(self) -> int:
        return duration_seconds(self.bucket)

    @property
    def agg_freq(self) -> int:
        """Expected readings per bucket."""
        return self.bucket_s // self.orig_freq_s
