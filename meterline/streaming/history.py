"""Statistics of a stream's whole history after each batch, from a state that merges.

Per sensor the state has counts, mean and sum of squared deviations (merged pairwise, without cancellation), the
range, and how many values lie in each bin of a fixed, increasing scale; per machine the number of closed
buckets.  A batch adds its own numbers to the state before it.  Ranks are exact in the bins, so a quartile or a
fence lies in a known bin: only the values of those few bins are read again, and the results are those of a report
over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterline.functions import violates_limits
from meterline.operators.dictionary import limits
from meterline.operators.outliers import far_from_mean, outside_fences
from meterline.operators.quantiles import value_bin
from meterline.operators.rollup import with_mean
from meterline.schema import QualityConfig
from meterline.session import settle
from meterline.streaming.jobs import _delete_matching

KEYS = ["machine", "sensor"]
PARTS = ("moments", "bins", "ticks")


def history_values(closed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(machine, sensor, ts, mean, bin, known, issue) of closed buckets."""
    known = limits(dictionary).select("sensor", "low_limit", "high_limit", F.lit(True).alias("known"))
    rows = with_mean(closed).select(*KEYS, F.col("bucket_start").alias("ts"), "mean").join(known, "sensor", "left")
    return rows.select(*KEYS, "ts", "mean", value_bin(F.col("mean")).alias("bin"), "known", violates_limits("mean").alias("issue"))


def state_of(values: DataFrame) -> dict[str, DataFrame]:
    """The state of some rows alone; a bucket of a machine closes in one batch, so its buckets can be counted by batch."""
    x = F.col("mean")
    return {
        "moments": values.groupBy(*KEYS).agg(
            F.count(x).alias("points"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"), F.min(x).alias("x0"), F.max(x).alias("x1"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if("issue").alias("issues"), F.bool_or("known").alias("known")),
        "bins": values.where(x.isNotNull()).groupBy(*KEYS, "bin").agg(F.count(x).alias("c")),
        "ticks": values.groupBy("machine").agg(F.count_distinct("ts").alias("cells")),
    }


def merged(one: dict[str, DataFrame], two: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The state of both: counts add up, deviations merge about the common mean."""
    a, b = (s["moments"].select(*KEYS, F.struct(*[c for c in s["moments"].columns if c not in KEYS]).alias(n)) for s, n in ((one, "a"), (two, "b")))
    n1, n2 = (F.coalesce(F.col(f"{n}.points"), F.lit(0).cast("bigint")) for n in "ab")
    shift = F.col("b.mean") - F.col("a.mean")
    both = (n1 > 0) & (n2 > 0)
    mean = F.when(both, F.col("a.mean") + shift * (n2 / (n1 + n2))).otherwise(F.coalesce("a.mean", "b.mean"))
    squares = F.when(both, F.col("a.squares") + F.col("b.squares") + shift * shift * (n1 * (n2 / (n1 + n2)))).otherwise(F.coalesce("a.squares", "b.squares"))
    added = F.coalesce(F.col("a.issues"), F.lit(0).cast("bigint")) + F.coalesce(F.col("b.issues"), F.lit(0).cast("bigint"))
    moments = a.join(b, KEYS, "full").select(
        *KEYS, (n1 + n2).alias("points"), mean.alias("mean"), squares.alias("squares"), *[f(f"a.{c}", f"b.{c}").alias(c) for c, f in (
            ("x0", F.least), ("x1", F.greatest), ("first_ts", F.least), ("last_ts", F.greatest))],
        added.alias("issues"), F.coalesce("b.known", "a.known").alias("known"))
    return {"moments": moments,
            "bins": one["bins"].unionByName(two["bins"]).groupBy(*KEYS, "bin").agg(F.sum("c").alias("c")),
            "ticks": one["ticks"].unionByName(two["ticks"]).groupBy("machine").agg(F.sum("cells").alias("cells"))}


def _quartiles(bins: DataFrame, moments: DataFrame, values: DataFrame) -> DataFrame:
    """(machine, sensor, q) with the quartiles of all values, by reading the bins that hold their ranks."""
    ranks = [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(F.lit(p) * (F.col("points") - 1)).alias("rank"),
                      (F.lit(p) * (F.col("points") - 1) % 1).alias("weight"))
             for i, p in enumerate((0.25, 0.5, 0.75)) for side, f in (("low", F.floor), ("high", F.ceil))]
    wanted = moments.where("points > 0").select(*KEYS, F.inline(F.array(*ranks)))

    def holding(counts: DataFrame, keys: list[str], order: str, targets: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        stacked = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
        return stacked.join(targets, keys).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))

    targets = settle(holding(bins, KEYS, "bin", wanted).select(*KEYS, "bin", "i", "side", "weight", (F.col("rank") - F.col("before")).alias("rank")), "ranks")
    inside = values.join(targets.select(*KEYS, "bin").distinct(), [*KEYS, "bin"]).groupBy(*KEYS, "bin", "mean").agg(F.count(F.lit(1)).alias("c"))
    found = holding(inside, [*KEYS, "bin"], "mean", targets).groupBy(*KEYS, "i", "weight").agg(
        F.max(F.when(F.col("side") == "low", F.col("mean"))).alias("low"), F.max(F.when(F.col("side") == "high", F.col("mean"))).alias("high"))
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("weight"))
    return (found.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))).alias("q")).select(*KEYS, F.col("q.v").alias("q")))


def _deviations(stats: DataFrame, bins: DataFrame, values: DataFrame, k: float) -> DataFrame:
    """(machine, sensor, outliers, zscore_outliers): whole bins beyond a bound are counted, those about it are read."""
    bounds = {"low": F.col("low_fence"), "high": F.col("high_fence"), "below": F.col("_avg") - F.col("_std") * k, "above": F.col("_avg") + F.col("_std") * k}
    edges = stats.select(*KEYS, "low_fence", "high_fence", "_avg", "_std", *[value_bin(b).alias(n) for n, b in bounds.items()])
    near = {n: F.abs(F.col("bin") - F.col(n)) <= 1 for n in bounds}  # a bin to either side, for bounds that rounding moves
    beyond = lambda low, high: (F.col("bin") < F.col(low) - 1) | (F.col("bin") > F.col(high) + 1)
    far = bins.join(edges, KEYS).groupBy(*KEYS).agg(
        F.sum(F.when(beyond("low", "high"), F.col("c")).otherwise(0)).alias("outliers"),
        F.sum(F.when(beyond("below", "above"), F.col("c")).otherwise(0)).alias("zscore_outliers"))
    about = values.join(bins.join(edges, KEYS).where(near["low"] | near["high"] | near["below"] | near["above"])
                        .select(*KEYS, "bin", *edges.columns[2:]), [*KEYS, "bin"])
    read = about.groupBy(*KEYS).agg(
        F.count_if((near["low"] | near["high"]) & outside_fences("mean")).alias("outliers"),
        F.count_if((near["below"] | near["above"]) & far_from_mean("mean", k)).alias("zscore_outliers"))
    return far.unionByName(read).groupBy(*KEYS).agg(F.sum("outliers").alias("outliers"), F.sum("zscore_outliers").alias("zscore_outliers"))


def history_report(state: dict[str, DataFrame], values: DataFrame, config: QualityConfig) -> DataFrame:
    """(machine, sensor, check, metric, value, status): the profile, completeness, outlier and accuracy rows of `quality_report`.

    *state* is that of all *values*, stored.  Values are read twice, each time for a few bins a sensor.
    """
    from meterline.plans.reports import deviation_rows, profile_rows

    q, reach = F.col("q"), (F.col("q")[2] - F.col("q")[0]) * 1.5
    moments = state["moments"].join(state["ticks"], "machine").withColumn("_avg", F.col("mean")).withColumn(
        "_std", F.when(F.col("points") > 1, F.sqrt(F.col("squares") / (F.col("points") - 1))))
    stats = settle(moments.join(_quartiles(state["bins"], state["moments"], values), KEYS, "left")
                   .withColumn("low_fence", q[0] - reach).withColumn("high_fence", q[2] + reach), "history")
    counted = _deviations(stats, state["bins"], values, config.zscore_k)
    none = F.lit(0).cast("bigint")
    judged = stats.join(counted, KEYS, "left").withColumns({c: F.coalesce(c, none) for c in ("outliers", "zscore_outliers")})
    return profile_rows(stats, config).unionByName(deviation_rows(judged))


def start_history_watch(rolled: DataFrame, dictionary: DataFrame, config: QualityConfig, path: str, checkpoint: str,
                        available_now: bool = True, run: str = "0") -> StreamingQuery:
    """A report over the whole history after each batch, in ``path/report/run=.../batch_id=...``; ``latest_report`` reads the newest.

    *rolled* is a stream rollup in append mode: a bucket comes once, when it has closed.  A batch writes its values,
    merges its state with that of the batch before and keeps the last two states; a batch that is repeated after a
    failure writes the same again.  A start with a new checkpoint numbers its batches anew: give it a greater *run*,
    so that it neither reads nor replaces what an earlier one wrote.
    """
    def folder(part: str, batch_id: int) -> str:
        return f"{path}/{part}/run={run}/batch_id={batch_id}"

    def watch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = history_values(batch, dictionary)
        rows.sortWithinPartitions(*KEYS, "bin").write.mode("overwrite").parquet(folder("values", batch_id))
        own = state_of(spark.read.schema(rows.schema).parquet(folder("values", batch_id)))
        state = merged({p: spark.read.parquet(folder(p, batch_id - 1)) for p in PARTS}, own) if batch_id else own
        for part in PARTS:
            state[part].write.mode("overwrite").parquet(folder(part, batch_id))
            if batch_id > 1:
                _delete_matching(spark, folder(part, batch_id - 2))
        stored = {p: spark.read.parquet(folder(p, batch_id)) for p in PARTS}
        values = spark.read.schema(rows.schema.add("batch_id", "long")).parquet(f"{path}/values/run={run}").where(F.col("batch_id") <= batch_id)
        history_report(stored, values, config).write.mode("overwrite").parquet(folder("report", batch_id))

    writer = rolled.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(watch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    """The report after the newest batch of the newest run."""
    reports = spark.read.parquet(f"{path}/report")
    newest = reports.agg(F.max(F.struct(F.col("run").cast("string").alias("run"), F.col("batch_id").cast("bigint").alias("batch_id"))).alias("m")).first().m
    if newest is None:
        return reports.drop("run", "batch_id")
    return reports.where((F.col("run").cast("string") == newest.run) & (F.col("batch_id") == newest.batch_id)).drop("run", "batch_id")
