import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterline.operators import correlation, distribution, strong, timeseries
from tests.conftest import at, found

SERIES = "machine string, sensor string, ts timestamp_ntz, idx bigint, mean double"


def series(rows, values, sensor="a", machine="m"):
    return rows(SERIES, *[(machine, sensor, at(i), i, v) for i, v in enumerate(values)])


@pytest.mark.parametrize("chunk", [24, 25, 4096])
def test_rolling(rows, chunk):
    data = series(rows, [float(i) for i in range(1, 27)])
    got = found(timeseries.rolling_mean(data, chunk_rows=chunk), "ts", "rolling_mean")
    assert [v for _, v in got] == [None] * 23 + [12.5, 13.5, 14.5]
    std = found(timeseries.rolling_std(data, chunk_rows=chunk), "ts", "rolling_std")
    assert std[23][1] == pytest.approx(np.std(range(1, 25), ddof=1))
    gap = series(rows, [float(i) if i != 6 else None for i in range(1, 27)])
    assert {v for _, v in found(timeseries.rolling_mean(gap, chunk_rows=chunk), "ts", "rolling_mean")} == {None}


def test_rolling_does_not_depend_on_partitions_or_chunks(rows):
    rng = np.random.default_rng(7)
    data = series(rows, [float(v) for v in rng.normal(size=700)])
    whole = found(timeseries.rolling_mean(data), "ts", "rolling_mean")
    cut = found(timeseries.rolling_mean(data.repartition(5), chunk_rows=64), "ts", "rolling_mean")
    assert len(whole) == len(cut) == 700
    assert [v for _, v in cut][23:] == pytest.approx([v for _, v in whole][23:])


@pytest.mark.parametrize("chunk", [24, 4096])
def test_decomposition(rows, chunk):
    data = series(rows, [t + (1.0 if t % 24 < 12 else -1.0) for t in range(72)])
    got = found(timeseries.seasonal_decompose(data, chunk_rows=chunk), "ts", "trend", "seasonal", "resid", "status")
    assert len(got) == 72
    for t, (_, trend, seasonal, resid, status) in enumerate(got):
        assert status == "ok" and seasonal == pytest.approx(1.0 if t % 24 < 12 else -1.0, abs=1e-9)
        if 12 <= t <= 59:
            assert trend == pytest.approx(t, abs=1e-9) and resid == pytest.approx(0, abs=1e-9)
        else:
            assert trend is None and resid is None


def test_decomposition_status(rows):
    data = (series(rows, [1.0] * 47, "short").unionByName(series(rows, [1.0] * 60 + [None], "holes"))
            .unionByName(series(rows, [1.0] * 48, "fine")))
    assert found(timeseries.decomposition_status(data), "sensor", "status") == [
        ("fine", "ok"), ("holes", "has_nulls"), ("short", "too_short")]
    parts = timeseries.seasonal_decompose(data)
    assert parts.where("status <> 'ok' and (trend is not null or seasonal is not null)").isEmpty()
    assert parts.groupBy("sensor").count().where("sensor = 'holes'").first()["count"] == 61


def test_odd_period(rows):
    x = np.random.default_rng(3).normal(size=40)
    got = found(timeseries.seasonal_decompose(series(rows, x.tolist()), period=7), "ts", "trend")
    expected = pd.Series(x).rolling(7, center=True).mean()
    assert [v for _, v in got][3:-3] == pytest.approx(expected.tolist()[3:-3])


def test_series_with_limits(rows):
    known = rows("tag string, tag_description string, machine_group string, low_threshold string, "
                 "high_threshold string, threshold_type string, aggregation_rule string",
                 ("a", "d", "g", "2", "4", "Down", "avg"))
    data = series(rows, [1.0] * 24).unionByName(series(rows, [1.0], "b"))
    got = timeseries.series_with_limits(data, known)
    assert found(got.select("sensor", "low_limit", "high_limit").distinct(), "sensor", "low_limit", "high_limit") == [
        ("a", 2.0, None), ("b", None, None)]


def pairs_of(df):
    return {(a, b): (r, n) for a, b, r, n in found(df, "sensor_a", "sensor_b", "r", "n_pairs")}


def test_correlation_goldens(rows):
    data = (series(rows, [1.0, 2.0, 3.0, None], "a").unionByName(series(rows, [1.0, 2.5, 2.0, 9.0], "b"))
            .unionByName(series(rows, [7.0, 7.0, 7.0, 8.0], "c")))
    for got in (pairs_of(correlation.correlation(data)), pairs_of(correlation.correlation_pivot(data, ["a", "b", "c"]))):
        assert got["a", "b"] == (pytest.approx(0.654654, abs=1e-6), 3)
        assert got["a", "c"] == (None, 3)  # constant over the common ticks
    assert correlation.strong_pairs(correlation.correlation(data)).select("sensor_a").collect()[0][0] == "b"


@pytest.mark.parametrize("block,ticks", [(256, 2160), (2, 2160), (3, 2), (1, 7)])
def test_correlation_blocks_equal_pandas(rows, block, ticks):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame(rng.normal(1e6, 1, size=(60, 7)), columns=list("gfedcba"))
    frame["b"] = frame["a"] * -2 + 5
    frame[rng.random(frame.shape) < 0.3] = np.nan
    frame["flat"] = 3.3
    data = rows(SERIES, *[("m", s, at(i), i, None if np.isnan(v) else float(v))
                          for s in frame for i, v in enumerate(frame[s])])
    got = pairs_of(correlation.correlation(data, slice_ticks=ticks, block_sensors=block))
    expected = frame.corr()
    if block == 3:
        minutes = data.withColumn("ts", F.expr("timestampadd(MINUTE, timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts), timestamp_ntz'2024-01-01')"))
        short = pairs_of(correlation.correlation(minutes, bucket="1 minute", slice_ticks=ticks, block_sensors=block))
        assert all(n == got[k][1] and (r is None) == (got[k][0] is None) and (r is None or abs(r - got[k][0]) < 1e-9) for k, (r, n) in short.items())
        assert set(short) == set(got)
    names = sorted(frame.columns)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for (a, b), (r, n) in got.items():
        assert n == (frame[a].notna() & frame[b].notna()).sum()
        if "flat" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-6)


@pytest.mark.parametrize("threshold,share", [(0.9, 0.25), (0.7, 0.5), (0.3, 1.0)])
def test_pruned_strong_pairs_equal_all(spark, threshold, share):
    """Smooth series in families of either sign, noise, constants, and sensors with ticks of their own; a machine without any large group."""
    rng = np.random.default_rng(5)
    n = 150
    t = np.arange(n) / n
    frame = {}
    for k in range(8):
        base = np.sin(2 * np.pi * (k % 4 + 1) * t + k) + 0.3 * rng.normal(size=n).cumsum() / np.sqrt(n)
        for i in range(6):
            frame[f"s{k}_{i}"] = (-1) ** i * 10**i * (base + 0.15 * rng.normal(size=n)) + 1e5
    frame["flat"], frame["noise"] = np.full(n, 2.5), rng.normal(size=n)
    for i in range(4):
        holed = frame[f"s{i}_0"] + 0.01 * rng.normal(size=n)
        holed[rng.random(n) < 0.2] = np.nan
        frame[f"h{i}"] = holed
    wide = pd.DataFrame(frame)
    wide["ts"] = [at(i) for i in range(n)]
    long = wide.melt("ts", var_name="sensor", value_name="mean").dropna()
    long["machine"] = "m"
    other = long[long.sensor.isin(["h0", "h1", "h2"])].assign(machine="k")
    data = spark.createDataFrame(pd.concat([long, other])[["machine", "sensor", "ts", "mean"]])
    want = found(correlation.strong_pairs(correlation.correlation(data), threshold), "machine", "sensor_a", "sensor_b", "r", "n_pairs")
    got = found(strong.find_strong_pairs(data, threshold, slice_ticks=40, block_sensors=16, least_group=8), "machine", "sensor_a", "sensor_b", "r", "n_pairs")
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want] and len(want) > 50
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))

    complete = data.where("machine = 'm' AND sensor NOT LIKE 'h%' AND sensor <> 'flat'")
    vectors = complete.select("machine", "sensor", F.struct(F.lit(n).cast("bigint").alias("n")).alias("group"), F.unix_timestamp("ts").alias("tick"),
                              ((F.col("mean") - F.avg("mean").over(Window.partitionBy("sensor")))
                               / F.stddev_pop("mean").over(Window.partitionBy("sensor")) / n**0.5).alias("u"))
    formed = strong.candidates(strong.sketches(vectors, 8), threshold).count()
    assert 0 < formed <= share * 49 * 48 / 2
    assert strong.find_strong_pairs(data.limit(0), threshold).isEmpty()


def test_machines_are_never_paired(rows):
    data = series(rows, [1.0, 2.0], "a", "m").unionByName(series(rows, [1.0, 2.0], "b", "k"))
    assert correlation.correlation(data).isEmpty()


def test_correlation_matrix(rows):
    data = series(rows, [1.0, 2.0, 3.0], "a").unionByName(series(rows, [5.0, 5.0, 5.0], "c"))
    cells = correlation.correlation_cells(correlation.correlation(data), data)
    assert found(cells, "sensor_a", "sensor_b", "r") == [("a", "a", 1.0), ("a", "c", None), ("c", "a", None), ("c", "c", None)]
    assert correlation.correlation_matrix(cells).columns == ["machine", "sensor", "a", "c"]


def test_box_stats(rows):
    data = series(rows, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    assert found(distribution.box_stats(data), "q1", "median", "q3", "low_whisker", "high_whisker", "fliers") == [
        (2.0, 3.0, 4.0, 1.0, 4.0, 1)]
    assert found(distribution.box_fliers(data), "value") == [(100.0,)]


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=300).round(2), np.array([4.0] * 9), np.array([1.0] * 50 + [2.0]),
    np.arange(11) / 10])
def test_histogram_equals_numpy(rows, values):
    got = found(distribution.histogram(series(rows, [float(v) for v in values]), dense=True), "bin", "count", "bin_low")
    spread = np.subtract(*np.percentile(values, [75, 25])) > 0
    counts, edges = np.histogram(values, bins="auto" if spread else "sturges")
    assert [c for _, c, _ in got] == counts.tolist()
    assert [e for _, _, e in got] == pytest.approx(edges[:-1].tolist())


def test_sparse_histogram_counts_everything(rows):
    values = [float(i % 5) for i in range(100)] + [1e4]
    bins = distribution.histogram(series(rows, values))
    assert bins.agg(F.sum("count")).first()[0] == 101 and bins.where("count = 0").isEmpty()


def test_density(rows):
    x = np.random.default_rng(5).normal(size=120).round(1)
    got = found(distribution.density(series(rows, x.tolist())), "point", "x", "density")
    grid = np.linspace(x.min(), x.max(), 200)
    bw = x.std(ddof=1) * len(x) ** -0.2
    expected = np.exp(-((grid[:, None] - x) / bw) ** 2 / 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert [p for p, _, _ in got] == list(range(200))
    assert [d for _, _, d in got] == pytest.approx(expected.tolist())
    flat = found(distribution.density(series(rows, [2.0, 2.0])), "density")
    assert set(flat) == {(None,)}


def test_dense_bins_are_all_listed_once(rows):
    layout = rows("machine string, sensor string, n_bins bigint, low double, bin_width double", *[("m", f"s{n}", n, 0.0, 1.0) for n in (1, 2, 3, 4, 5, 16, 17, 1000)])
    got = found(distribution._listed_bins(layout), "n_bins", "bin")
    assert got == sorted((n, b) for n in (1, 2, 3, 4, 5, 16, 17, 1000) for b in range(n))


@pytest.mark.parametrize("values", [np.random.default_rng(3).normal(1e4, 3, 700), np.r_[np.arange(40.0), 1e4], np.repeat([1.0, 2.0, 7.0], 5), [1.0, 2.0]])
def test_density_from_moments_equals_values(rows, values):
    data = series(rows, [float(v) for v in values]).unionByName(series(rows, [2.0, 2.0, None], "flat"))
    whole = found(distribution.density(data), "sensor", "point", "x", "density")
    binned = found(distribution.density(data, method="moments"), "sensor", "point", "x", "density")
    assert [w[:3] for w in whole] == [b[:3] for b in binned] and len(whole) == 400
    peak = max(w[3] or 0 for w in whole)
    assert all((w[3] is None) == (b[3] is None) and (w[3] is None or abs(w[3] - b[3]) < 1e-9 * peak) for w, b in zip(whole, binned))
    assert distribution.density(data.limit(0), method="moments").isEmpty()
