"""Comparison of image or feature populations: calibration, neighbours, density and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from .binning import bins
from .dist import kernel_distance, standardised, wasserstein
from .metric_space import ball_counts, build, nearest_k
from .quantiles import median, quantile_table, quantiles


def nearest(queries: DataFrame, base: DataFrame, key: str, vec: str) -> DataFrame:
    """(q, distance): from each query to its nearest base vector other than itself."""
    return nearest_k(build(base, key, vec), queries, key, vec).select("q", F.sqrt("d2").alias("distance"))


def kth_distance(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(q, distance): to the k-th nearest other vector of the same set; sets of k rows or fewer have none."""
    return nearest_k(build(df, key, vec), df, key, vec, k).where(F.col("r") == k).select("q", F.sqrt("d2").alias("distance"))


def density_coverage(real: DataFrame, other: DataFrame, key: str, vec: str, k: int = 5) -> DataFrame:
    """One row: density and coverage of ``other`` in the k-neighbour balls of ``real``; null if a set has fewer than k + 1 rows."""
    radii = kth_distance(real, key, vec, k).withColumnRenamed("q", key)
    balls = real.select(key, vec).join(radii, key)
    hits = ball_counts(build(other, key, vec), balls, key, vec, "distance")
    row = hits.agg(F.sum("n").alias("inside"), F.avg((F.col("n") > 0).cast("double")).alias("coverage"), F.count("*").alias("nr")).crossJoin(other.agg(F.count("*").alias("ng")))
    enough = (F.col("nr") > k) & (F.col("ng") > k)
    return row.select(F.when(enough, F.col("inside") / (k * F.col("ng"))).alias("density"), F.when(enough, F.col("coverage")).alias("coverage"))


def listed(row: DataFrame) -> DataFrame:
    """(metric, value) of a one-row table's columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("m")).select("m.*")


def _values(spark: SparkSession, found: Mapping[str, float | None]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in found.items()], "metric string, value double")


def distribution_report(df: DataFrame, key: str, props: Sequence[str], side: str, real: object, generated: object, k: int = 5) -> DataFrame:
    """(metric, value): how two populations' properties differ.

    Numbers of rows, for each property the distance of its distributions and both medians, and on the properties standardised by the real
    population the kernel distance, density and coverage (null if a population has fewer than k + 1 rows).
    """
    rows = stored(df.select(key, side, *[F.col(p).cast("double").alias(p) for p in props]), "properties")
    ours = {v: rows.where(F.col(side) == v) for v in (real, generated)}
    found: dict[str, float | None] = {"n_generated": ours[generated].count(), "n_real": ours[real].count()}
    for p in props:
        found[f"gen_median_{p}"], found[f"real_median_{p}"] = median(ours[generated], p), median(ours[real], p)
    out = _values(df.sparkSession, found)
    for p in props:
        out = out.unionByName(wasserstein(rows, p, side, real, generated).select(F.lit(f"w1_{p}").alias("metric"), F.col("w1").alias("value")))
    scaled = stored(standardised(rows, ours[real], props).withColumn("_v", F.array(*props)), "standardised")
    out = out.unionByName(listed(kernel_distance(scaled, props, side, real, generated).select(F.col("mmd2").alias("kernel_distance"))))
    return out.unionByName(listed(density_coverage(scaled.where(F.col(side) == real), scaled.where(F.col(side) == generated), key, "_v", k)))


def memorisation_report(generated: DataFrame, train: DataFrame, val: DataFrame | None, key: str, vec: str) -> DataFrame:
    """(metric, value): distances to the nearest training vector, beside those of held-out vectors.

    Median and 5th percentile of the generated distances; with ``val`` also its median, the ratio of both medians (below 1: the generated lie
    closer than unseen ones do) and the distance of both distributions.
    """
    index = build(train, key, vec)
    near = lambda rows: nearest_k(index, rows, key, vec, others=False).select(F.sqrt("d2").alias("d"))
    own = stored(near(generated), "distances")
    got = quantiles(own, "d", [0.5, 0.05]).get((), (0, [None, None]))[1]
    found: dict[str, float | None] = {"gen_nn_median": got[0], "gen_nn_p05": got[1]}
    if val is None:
        return _values(generated.sparkSession, found)
    held = stored(near(val), "distances")
    found["val_nn_median"] = median(held, "d")
    found["median_ratio_gen_over_val"] = None if None in found.values() else found["gen_nn_median"] / (found["val_nn_median"] + 1e-30)
    both = own.select("d", F.lit("gen").alias("side")).unionByName(held.select("d", F.lit("val").alias("side")))
    return _values(generated.sparkSession, found).unionByName(wasserstein(both, "d", "side", "gen", "val").select(F.lit("w1_gen_vs_val").alias("metric"), F.col("w1").alias("value")))


def calibration(df: DataFrame, asked: str, measured: str) -> DataFrame:
    """One row: log-log slope, intercept and R2, multiplicative bias and scatter in dex, over positive pairs."""
    good = df.where((F.col(asked) > 0) & (F.col(measured) > 0)).select(F.log10(asked).alias("x"), F.log10(measured).alias("y"))
    middle = F.lit(median(good, F.col("y") - F.col("x"))).cast("double")
    return good.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.pow(F.lit(10.0), middle).alias("bias"), F.stddev_pop(F.col("y") - F.col("x")).alias("scatter"))


def calibration_curve(df: DataFrame, asked: str, measured: str, edges: Sequence[float]) -> DataFrame:
    """(bin, lo, hi, n, ratio, scatter) over bins of log10 of ``asked``; values beyond the ends go to the end bins."""
    n = len(edges) - 1
    good = df.where((F.col(asked) > 0) & (F.col(measured) > 0)).select(F.log10(asked).alias("x"), F.log10(measured).alias("y"))
    index = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("x"))) - 1))
    placed = good.select(index.alias("bin"), (F.col("y") - F.col("x")).alias("off"))
    got = placed.groupBy("bin").agg(F.count("*").alias("n"), F.stddev_pop("off").alias("scatter"))
    middle = quantile_table(placed, "off", {"middle": 0.5}, ["bin"]).select("bin", F.pow(F.lit(10.0), F.col("middle")).alias("ratio"))
    return bins(df, edges).join(got, "bin", "left").join(middle, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def report_per_group(df: DataFrame, by: str, problem: Column, means: Mapping[str, Column], medians: Mapping[str, Column]) -> DataFrame:
    """(by, n, error, metrics..): a row for each group; a group with a row whose ``problem`` is not null has NaN metrics and its least problem.

    The others keep their values.  Metrics of rows with a problem are not worked out.  Groups are few (snapshots).
    """
    rows = df.select(by, problem.alias("_p"), *[F.when(problem.isNull(), c).alias(k) for k, c in {**means, **medians}.items()])
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("_p").alias("error"), *[F.avg(k).alias(k) for k in means])
    for k in medians:
        out = out.join(F.broadcast(quantile_table(rows, k, {f"_{k}": 0.5}, [by]).withColumnRenamed(by, "_by")), F.col(by).eqNullSafe(F.col("_by")), "left").withColumn(k, F.col(f"_{k}")).drop("_by", f"_{k}")
    nan = F.lit(float("nan"))
    return out.select(by, "n", "error", *[F.when(F.col("error").isNotNull(), nan).otherwise(F.coalesce(k, nan)).alias(k) for k in (*means, *medians)])
