from meterline.functions.expr import (
    digits_only,
    limit_columns,
    no_nan,
    plot_label,
    seconds_between,
    violates_limits,
)
from meterline.functions.joins import measure_hot, salted_join

__all__ = [
    "digits_only", "limit_columns", "measure_hot", "no_nan", "plot_label",
    "salted_join", "seconds_between", "violates_limits",
]
