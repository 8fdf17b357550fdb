"""Pearson correlation of a machine's sensors over their common ticks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from meterline.functions import salted_join
from meterline.schema import duration_seconds

_PARTIAL = ("machine string, sensor_a string, sensor_b string, n bigint, sx double, sy double, sxx double, "
            "syy double, sxy double, x_lo double, x_hi double, y_lo double, y_hi double")


def _block_sums():
    """Kernel: sums of all sensor pairs in one (machine, time slice, block pair).

    Kept a closure so that executors need nothing but numpy and pandas.
    """
    def kernel(key, frame):
        import numpy as np
        import pandas as pd

        machine, _, left, right = key
        tick, _ = pd.factorize(frame["tick"])
        code, names = pd.factorize(frame["sensor"], sort=True)
        raw = np.full((tick.max() + 1, len(names)), np.nan)
        raw[tick, code] = frame["x"].to_numpy()
        shift = np.empty(len(names))
        shift[code] = frame["centre"].to_numpy()
        block = np.empty(len(names), dtype=np.int64)
        block[code] = frame["block"].to_numpy()

        a_at, b_at = np.flatnonzero(block == left), np.flatnonzero(block == right)
        has = ~np.isnan(raw)
        centred = np.where(has, raw - shift, 0.0)
        mask = has.astype(float)
        a, b, ma, mb = centred[:, a_at], centred[:, b_at], mask[:, a_at], mask[:, b_at]
        n, sx, sy = ma.T @ mb, a.T @ mb, ma.T @ b
        sxx, syy, sxy = (a * a).T @ mb, ma.T @ (b * b), a.T @ b

        def extent(own, other, common, total, square):
            """Range of a sensor over the common ticks, looked up only where the sums suggest a constant."""
            lo, hi = np.full(common.shape, -np.inf), np.full(common.shape, np.inf)
            with np.errstate(invalid="ignore", divide="ignore"):
                flat = (common > 0) & (square - total * total / common <= 1e-9 * square)
            for i in np.flatnonzero(flat.any(axis=1)):
                js = np.flatnonzero(flat[i])
                both = has[:, own[i]][:, None] & has[:, other[js]]
                column = raw[:, own[i]][:, None]
                lo[i, js] = np.where(both, column, np.inf).min(axis=0)
                hi[i, js] = np.where(both, column, -np.inf).max(axis=0)
            return lo, hi

        x_lo, x_hi = extent(a_at, b_at, n, sx, sxx)
        y_lo, y_hi = (e.T for e in extent(b_at, a_at, n.T, sy.T, syy.T))
        i, j = np.nonzero((n > 0) & ((a_at[:, None] < b_at[None, :]) | (left != right)))
        first, second = names[a_at[i]], names[b_at[j]]
        swap = np.asarray(first > second, dtype=bool)

        def pick(u, v):
            return np.where(swap, v[i, j], u[i, j])

        return pd.DataFrame({
            "machine": machine, "sensor_a": np.where(swap, second, first),
            "sensor_b": np.where(swap, first, second), "n": n[i, j].astype("int64"),
            "sx": pick(sx, sy), "sy": pick(sy, sx), "sxx": pick(sxx, syy), "syy": pick(syy, sxx),
            "sxy": sxy[i, j], "x_lo": pick(x_lo, y_lo), "x_hi": pick(x_hi, y_hi),
            "y_lo": pick(y_lo, x_lo), "y_hi": pick(y_hi, x_hi)})

    return kernel


def correlation(series: DataFrame, value: str = "mean", bucket: str = "1 hour", slice_ticks: int = 2160,
                block_sensors: int = 256) -> DataFrame:
    """(machine, sensor_a, sensor_b, r, n_pairs), a before b, for pairs with a common tick.

    A blocked matrix product.  Sensors hash into blocks of about *block_sensors* and time into
    slices of *slice_ticks* buckets, so a task holds two blocks of one slice whatever the machine's
    size and however short the buckets, and only six sums per pair and slice leave it.  r is NULL when either sensor is constant
    over the common ticks.
    """
    rows = _tick_rows(series, value)
    per_sensor = rows.groupBy("machine", "sensor").agg(F.avg("x").alias("centre"))
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("machine")) / F.lit(block_sensors)).cast("int")
    placed = per_sensor.select(
        "machine", "sensor", "centre", F.sequence(F.lit(0), blocks - 1).alias("partners"),
        F.pmod(F.xxhash64("sensor"), blocks).cast("int").alias("block"))
    return correlate_blocks(rows, placed, duration_seconds(bucket) * slice_ticks)


def _tick_rows(series: DataFrame, value: str) -> DataFrame:
    return series.where(F.col(value).isNotNull()).select(
        "machine", "sensor", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("tick"),
        F.col(value).cast("double").alias("x"))


def correlate_blocks(rows: DataFrame, placed: DataFrame, slice_s: int) -> DataFrame:
    """Correlation of *rows* (machine, sensor, tick, x) for the pairs of blocks that *placed* asks for.

    *placed* has (machine, sensor, centre, block, partners): a sensor meets the sensors of the blocks in *partners*.
    """
    cells = (
        salted_join(rows, placed, ["machine", "sensor"], "tick")
        .withColumn("partner", F.explode("partners"))
        .select("machine", F.expr(f"tick div {slice_s}").alias("slice"),
                F.least("block", "partner").alias("left"), F.greatest("block", "partner").alias("right"),
                "block", "sensor", "tick", "x", "centre")
    )
    partial = cells.groupBy("machine", "slice", "left", "right").applyInPandas(_block_sums(), _PARTIAL)
    sums = partial.groupBy("machine", "sensor_a", "sensor_b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        *[F.min(c).alias(c) for c in ("x_lo", "y_lo")], *[F.max(c).alias(c) for c in ("x_hi", "y_hi")])
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    varied = (F.col("x_lo") < F.col("x_hi")) & (F.col("y_lo") < F.col("y_hi")) & (vx > 0) & (vy > 0)
    r = F.when(varied & (n > 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    return sums.select("machine", "sensor_a", "sensor_b", r.alias("r"), n.alias("n_pairs"))


def safe_correlation(x: Column, y: Column) -> Column:
    """Aggregate: r over rows where both are present; NULL for a constant or a single row."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(vx * vy))


def correlation_pivot(series: DataFrame, sensors: list[str], value: str = "mean",
                      pairs_per_pass: int = 60) -> DataFrame:
    """Same result from built-in aggregates over a pivoted table, for a few known sensors."""
    wide = series.groupBy("machine", F.col("ts")).pivot("sensor", sensors).agg(F.first(value))
    pairs = list(combinations(sorted(sensors), 2))
    passes = []
    for start in range(0, len(pairs), pairs_per_pass):
        chosen = pairs[start:start + pairs_per_pass]
        aggregates = []
        for k, (a, b) in enumerate(chosen):
            x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
            aggregates += [safe_correlation(x, y).alias(f"r{k}"),
                           F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{k}")]
        cells = F.array(*[
            F.struct(F.lit(a).alias("sensor_a"), F.lit(b).alias("sensor_b"), F.col(f"r{k}").alias("r"),
                     F.col(f"n{k}").alias("n_pairs")) for k, (a, b) in enumerate(chosen)])
        passes.append(wide.groupBy("machine").agg(*aggregates).select("machine", F.inline(cells)))
    result = passes[0]
    for more in passes[1:]:
        result = result.unionByName(more)
    return result.where("n_pairs > 0")


def strong_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with \\|r\\| above *threshold*; an undefined r is never strong."""
    return pairs.where(F.abs("r") > threshold)


def correlation_cells(pairs: DataFrame, series: DataFrame, value: str = "mean") -> DataFrame:
    """Heat-map cells (machine, sensor_a, sensor_b, r): both orders plus the diagonal."""
    mirrored = pairs.select("machine", F.col("sensor_b").alias("sensor_a"), F.col("sensor_a").alias("sensor_b"), "r")
    diagonal = series.groupBy("machine", "sensor").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(
        "machine", F.col("sensor").alias("sensor_a"), F.col("sensor").alias("sensor_b"),
        F.when(F.col("lo") < F.col("hi"), F.lit(1.0)).alias("r"))
    return pairs.select("machine", "sensor_a", "sensor_b", "r").unionByName(mirrored).unionByName(diagonal)


def correlation_matrix(cells: DataFrame, sensors: list[str] | None = None) -> DataFrame:
    """Square form of ``correlation_cells``: one column per sensor."""
    return cells.groupBy("machine", F.col("sensor_a").alias("sensor")).pivot("sensor_b", sensors).agg(F.first("r"))
