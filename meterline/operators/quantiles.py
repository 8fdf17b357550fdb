"""Exact quantiles, per key, with linear interpolation between order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import salted_join
from meterline.session import settle

BINS = 4096
#: Where infinite values stand on the squashed scale: beyond the logarithm of the largest double.
BEYOND = 1000.0
#: Bins of one unit of the scale log(1 + |x|), and the bin of the largest double.
FINE, LAST = 64, 50_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    method: str = "percentile", gather: int = 1_000_000, spread_by: str = "ts",
                    bins: DataFrame | None = None) -> DataFrame:
    """(keys..., quantiles ARRAY<DOUBLE>) of the non-null values, in the order of *probs*.

    ``percentile``  the built-in: one shuffle, but one task holds every distinct value
                    of a key.  Right for rollups, whose keys have one value per bucket.
    ``refine``      for raw readings, where one key may own a third of all rows: counts in the bins
                    of a fixed scale give each rank its bin exactly, and one more scan counts the values
                    of these bins.  Bins of more than *gather* values are cut further first.  Same
                    result; only counts are shuffled.  *spread_by* scatters a key's rows should the
                    ranges not fit a broadcast.  *bins* are stored ``value_bins`` of the same rows, which
                    merge and so are kept beside a rollup: with them the values are read once.
                    The caller chooses the method; no size does.
    """
    x = F.col(value).cast("double").alias("x")
    present = df.where(F.col(value).isNotNull())
    if method == "percentile":
        return _built_in(present.select(*keys, x), keys, probs)
    if method != "refine":
        raise ValueError("method is 'percentile' or 'refine'")
    values = present.select(*keys, x, F.col(spread_by).alias("_by"))
    if bins is None:
        bins = value_bins(values, keys, "x")
    return _refined(values, keys, [float(p) for p in probs], gather, settle(bins.where("bin IS NOT NULL").select(*keys, "bin", "c", "lo", "hi"), "bins"))


def value_bin(x: Column) -> Column:
    """The value's bin on a fixed scale: it never falls as x rises, so ranks can be counted in bins; NaN is the greatest."""
    size = F.least(F.floor(F.log1p(F.abs(x)) * FINE), F.lit(LAST).cast("bigint")).cast("int")
    far = F.when(x > 0, LAST + 1).otherwise(-LAST - 2)
    return F.when(F.isnan(x), LAST + 2).when(F.abs(x) == float("inf"), far).when(x >= 0, size).otherwise(-size - 1)


def value_bins(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., bin, c, lo, hi, mean, squares): values of each bin, how many, their range, mean and squared deviations.

    Combined before the shuffle; a key has some hundred bins, however many rows.  Rows without a value make a bin
    NULL of count 0, so that no key is lost.
    """
    x = F.col(value).cast("double")
    return (df.groupBy(*keys, value_bin(x).alias("bin"))
            .agg(F.count(x).alias("c"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares")))


def merge_bins(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Bins of all the rows behind *parts*; deviations are merged about the common mean."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    c = F.col("c")
    mean = F.try_divide(F.sum(F.col("mean") * c).over(Window.partitionBy(*keys, "bin")), F.sum(c).over(Window.partitionBy(*keys, "bin")))
    about = F.coalesce(F.col("squares"), F.lit(0.0)) + c * (F.col("mean") - F.col("common")) * (F.col("mean") - F.col("common"))
    return (rows.withColumn("common", mean).groupBy(*keys, "bin")
            .agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("common").alias("mean"), F.sum(about).alias("squares")))


def bin_moments(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, mean, std, min, max) of the values behind *bins*."""
    c = F.col("c")
    totals = bins.groupBy(*keys).agg(F.sum("c").alias("n"), F.try_divide(F.sum(F.col("mean") * c), F.sum("c")).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    shift = F.col("own") - F.col("mean")
    spread = (bins.withColumnRenamed("mean", "own").join(totals.select(*keys, "mean"), keys).groupBy(*keys)
              .agg(F.sum(F.col("squares") + c * shift * shift).alias("squares")))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return totals.join(spread, keys).select(*keys, "n", "mean", std.alias("std"), "min", "max")


def _built_in(values: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.percentile("x", F.array(*[F.lit(float(p)) for p in probs])).alias("quantiles"))


def _refined(values: DataFrame, keys: list[str], probs: list[float], gather: int, bins: DataFrame) -> DataFrame:
    # A target is one order statistic next to a rank p*(n-1): a value range known to hold it
    # and its rank inside.  The targets, one row per key, are written each time: their real
    # size then decides whether the next scan broadcasts them, and no scan repeats an earlier one.
    wanted = []
    for i, p in enumerate(probs):
        rank = F.lit(p) * (F.col("n") - 1)
        for side, r in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            wanted.append(F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), r.alias("rank"), (rank - F.floor(rank)).alias("weight")))
    own = Window.partitionBy(*keys)
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = bins.withColumn("n", F.sum("c").over(own)).withColumn("before", F.sum("c").over(upto) - F.col("c"))
    held = F.filter(F.array(*wanted), lambda t: (F.col("before") <= t["rank"]) & (t["rank"] < F.col("before") + F.col("c")))
    found = F.transform(held, lambda t: F.struct(
        t["q"].alias("q"), t["side"].alias("side"), (t["rank"] - F.col("before")).alias("rank"), t["weight"].alias("weight"),
        F.col("c").alias("size"), F.col("lo").alias("lo"), F.col("hi").alias("hi")))
    targets = settle(stacked.withColumn("found", found).where(F.size("found") > 0).groupBy(*keys)
                     .agg(F.flatten(F.collect_list("found")).alias("targets")), "targets")
    ranges = 2 * len(probs)
    # A range's ends fall into different bins, so every level splits it; a double has no more
    # than a few such splits in it.
    while _crowded(targets, gather):
        targets = settle(_narrowed(values, keys, targets, ranges), "targets")

    counts = _in_ranges(values, keys, targets, ranges).groupBy(*keys, "lo", "hi", "x").agg(
        F.count(F.lit(1)).alias("c"))
    found = _ranked(counts, keys, targets, "x").groupBy(*keys, "t.q", "t.weight").agg(
        F.max(F.when(F.col("t.side") == "low", F.col("x"))).alias("x0"),
        F.max(F.when(F.col("t.side") == "high", F.col("x"))).alias("x1"))
    between = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("weight")
    answer = F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise(between)  # two infinities have no difference
    return (found.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("q", answer.alias("v")))).alias("a"))
            .select(*keys, F.col("a.v").alias("quantiles")))


def _crowded(targets: DataFrame, gather: int) -> bool:
    """Whether some range still holds more than *gather* values, not all of them equal."""
    return not targets.where(F.expr(f"exists(targets, t -> t.size > {int(gather)} AND t.lo < t.hi)")).isEmpty()


def _squashed(x: Column) -> Column:
    """Increasing, slow and finite: a far or infinite outlier does not push all other values into one bin."""
    return F.signum(x) * F.when(F.abs(x) == float("inf"), F.lit(BEYOND)).otherwise(F.log1p(F.abs(x)))


def _in_ranges(values: DataFrame, keys: list[str], targets: DataFrame, ranges: int) -> DataFrame:
    """(keys, lo, hi, x): the values inside a target's range.  Ranges of a key are disjoint."""
    bounds = targets.select(*keys, F.expr("array_distinct(transform(targets, t -> struct(t.lo, t.hi)))").alias("r"))
    bounds = bounds.select(*keys, *[F.get("r", F.lit(i)).alias(f"r{i}") for i in range(ranges)])
    x = F.col("x")
    hit = F.coalesce(*[F.when((x >= F.col(f"r{i}.lo")) & (x <= F.col(f"r{i}.hi")), F.col(f"r{i}"))
                       for i in range(ranges)])
    return (salted_join(values, bounds, keys, "_by").withColumn("r", hit).where(F.col("r").isNotNull())
            .select(*keys, "r.lo", "r.hi", "x"))


def _ranked(counts: DataFrame, keys: list[str], targets: DataFrame, order: str) -> DataFrame:
    """Per target ``t`` the count row that holds its rank, with ``before``: values of the range ahead of it."""
    upto = Window.partitionBy(*keys, "lo", "hi").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    stacked = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
    wanted = targets.select(*keys, F.explode("targets").alias("t")).select(
        *keys, "t", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"))
    return (stacked.join(wanted, [*keys, "lo", "hi"])
            .where((F.col("before") <= F.col("t.rank")) & (F.col("t.rank") < F.col("before") + F.col("c"))))


def _narrowed(values: DataFrame, keys: list[str], targets: DataFrame, ranges: int) -> DataFrame:
    """Targets shrunk to the bin that holds their rank, between the bin's smallest and largest value.

    Bins are even on the values' own scale, and on the squashed one for ranges too wide to subtract.
    """
    wide = (F.abs(F.col("hi") - F.col("lo")) == float("inf")) | F.isnan(F.col("hi") - F.col("lo"))
    lo, hi, x = (F.when(wide, _squashed(F.col(c))).otherwise(F.col(c)) for c in ("lo", "hi", "x"))
    place = F.floor(F.try_divide(x - lo, hi - lo) * BINS)
    bins = F.coalesce(F.least(place, F.lit(BINS - 1).cast("bigint")), F.lit(0).cast("bigint"))
    counts = (_in_ranges(values, keys, targets, ranges).groupBy(*keys, "lo", "hi", bins.alias("bin"))
              .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("x0"), F.max("x").alias("x1")))
    narrowed = F.struct(
        F.col("t.q").alias("q"), F.col("t.side").alias("side"),
        (F.col("t.rank") - F.col("before")).alias("rank"), F.col("t.weight").alias("weight"),
        F.col("c").alias("size"), F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    return (_ranked(counts, keys, targets, "bin").groupBy(*keys)
            .agg(F.collect_list(narrowed).alias("targets")))
