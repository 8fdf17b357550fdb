"""Data-quality analytics for high-frequency sensor readings, on Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame.  The data model
is long: one row per (machine, sensor, bucket) instead of one column per sensor.
"""

from meterline.schema import QualityConfig

__all__ = ["QualityConfig"]
