"""Empirical distributions: cleaning, statistics, distances, power transforms, sampling."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sky import number
from ..sources.storage import stored
from .quantiles import quantile_table, quantiles


def clean(df: DataFrame, x: str, below: float | None = None) -> DataFrame:
    """Rows whose ``x`` is a positive number and, if asked, strictly below that percentile (0 to 1, linear) of these."""
    good = df.where(F.coalesce(number(F.col(x)) > 0, F.lit(False)))
    if below is None:
        return good
    found = quantiles(good, x, [below])
    return good.where(F.col(x) < F.lit(found[()][1][0])) if found else good


def statistics(df: DataFrame, x: str) -> DataFrame:
    """One row: count, mean, median, population deviation, 90th, 95th and 99th percentile of the numbers in a column."""
    own = number(F.col(x))
    shares = quantile_table(df, x, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return df.agg(F.count(own).alias("n"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("std")).crossJoin(F.broadcast(shares))


def standardised(df: DataFrame, reference: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``cols`` less the reference's mean over its population deviation (1 where that is 0)."""
    stats = reference.agg(*(F.avg(c).alias(f"_m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"_s_{c}") for c in cols))
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")))
    return out.drop(*(f"_{k}_{c}" for k in "ms" for c in cols))


def ranked(df: DataFrame, order: Sequence[str], out: str, parts: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) by the columns ``order``: ranges are ranked apart and start at what lies before them.

    There are as many ranges as shuffle partitions, unless ``parts`` says otherwise.  They are numbered by their borders' order and stored once, so that a task that runs again cannot deal them anew.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(out, place).join(F.broadcast(before), "_part").withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_part", "_before")


def wasserstein(df: DataFrame, x: str, side: str, one: object, two: object, parts: int | None = None) -> DataFrame:
    """One row ``w1``: the area between the cumulative curves of two groups of a column.

    Values are counted first; ranges of values are summed apart, and each range gets what lies before it, so no window has the whole column.
    """
    sums = df.where(F.col(side).isin(one, two)).groupBy(F.col(x).alias("v")).agg(F.count_if(F.col(side) == one).alias("a"), F.count_if(F.col(side) == two).alias("b"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sums.repartitionByRange(parts, "v").withColumn("_part", F.spark_partition_id())
    # the range numbers must not change between uses: they come from the values' borders
    borders = ranged.groupBy("_part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    over = Window.orderBy("lo")
    heads = borders.select("lo", "hi", F.coalesce(F.sum("sa").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a0"), F.coalesce(F.sum("sb").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b0"), F.lead("lo").over(over).alias("next_lo"))
    totals = borders.agg(F.sum("sa").alias("na"), F.sum("sb").alias("nb"))
    inside = sums.join(F.broadcast(heads), F.col("v").between(F.col("lo"), F.col("hi")))
    w = Window.partitionBy("lo").orderBy("v")
    gap = F.coalesce(F.lead("v").over(w), F.col("next_lo")) - F.col("v")
    steps = inside.withColumns({"ca": F.col("a0") + F.sum("a").over(w), "cb": F.col("b0") + F.sum("b").over(w), "gap": gap}).crossJoin(F.broadcast(totals))
    return steps.agg(F.sum(F.abs(F.try_divide("ca", "na") - F.try_divide("cb", "nb")) * F.col("gap")).alias("w1"))


def kernel_distance(df: DataFrame, cols: Sequence[str], side: str, one: object, two: object, degree: int = 3, coef0: float = 1.0) -> DataFrame:
    """One row ``mmd2``: the unbiased squared distance of two groups under the kernel (x.y / D + coef0)^degree.

    The kernel's sum over all pairs is a weighted sum of products of monomial sums, so one aggregation does it in linear time.
    """
    d = len(cols)
    monomials = [m for n in range(degree + 1) for m in itertools.combinations_with_replacement(range(d), n)]

    def weight(m: tuple[int, ...]) -> float:
        n = len(m)
        arrangements = math.factorial(n) / math.prod(math.factorial(m.count(i)) for i in set(m))
        return math.comb(degree, n) * arrangements * coef0 ** (degree - n) / d**n

    product = lambda m: F.lit(1.0) if not m else math.prod((F.col(cols[i]).cast("double") for i in m[1:]), start=F.col(cols[m[0]]).cast("double"))
    norm = sum((F.col(c).cast("double") * F.col(c) for c in cols[1:]), start=F.col(cols[0]).cast("double") * F.col(cols[0]))
    own = F.pow(norm / d + coef0, degree)
    aggs = []
    for k, v in enumerate((one, two)):
        mine = F.col(side) == v
        aggs += [F.sum(F.when(mine, product(m)).otherwise(0.0)).alias(f"s{k}_{i}") for i, m in enumerate(monomials)]
        aggs += [F.count_if(mine).alias(f"n{k}"), F.sum(F.when(mine, own).otherwise(0.0)).alias(f"d{k}")]
    row = df.where(F.col(side).isin(one, two)).agg(*aggs)
    total = lambda p, q: sum((weight(m) * F.col(f"s{p}_{i}") * F.col(f"s{q}_{i}") for i, m in enumerate(monomials)), start=F.lit(0.0))
    within = lambda k: F.try_divide(total(k, k) - F.col(f"d{k}"), F.col(f"n{k}") * (F.col(f"n{k}") - 1))
    return row.select((within(0) + within(1) - 2 * F.try_divide(total(0, 1), F.col("n0") * F.col("n1"))).alias("mmd2"))


def box_cox(df: DataFrame, x: str, lambdas: Sequence[float]) -> DataFrame:
    """(lam, loglik) of the power transform for each exponent, by one aggregation over the column's positive values."""
    good = clean(df, x)
    power = lambda lam: F.ln(x) if lam == 0 else (F.pow(F.col(x), lam) - 1) / lam
    row = good.agg(F.count("*").alias("n"), F.sum(F.ln(x)).alias("s"), *(F.var_pop(power(v)).alias(f"v{i}") for i, v in enumerate(lambdas)))
    parts = F.array(*(F.struct(F.lit(float(v)).alias("lam"), ((v - 1) * F.col("s") - F.col("n") / 2 * F.ln(F.col(f"v{i}"))).alias("loglik")) for i, v in enumerate(lambdas)))
    return row.select(F.explode(parts).alias("r")).select("r.*")


def best_lambda(df: DataFrame, x: str, lo: float = -2.0, hi: float = 2.0, rounds: int = 3, points: int = 21) -> tuple[float, float, float]:
    """(exponent of greatest likelihood, mean and deviation of the transformed values): a grid, refined around its best point."""
    for _ in range(rounds):
        grid = np.linspace(lo, hi, points).tolist()
        best = box_cox(df, x, grid).orderBy(F.desc("loglik"), "lam").first().lam
        step = (hi - lo) / (points - 1)
        lo, hi = best - step, best + step
    t = power_transform(F.col(x), best)
    got = clean(df, x).agg(F.avg(t).alias("m"), F.stddev_pop(t).alias("s")).first()
    return best, got.m, got.s


def power_transform(x: Column, lam: float, mean: float = 0.0, std: float = 1.0) -> Column:
    return ((F.ln(x) if lam == 0 else (F.pow(x, lam) - 1) / lam) - mean) / std


def power_inverse(y: Column, lam: float, mean: float = 0.0, std: float = 1.0) -> Column:
    v = y * std + mean
    return F.exp(v) if lam == 0 else F.pow(F.greatest(v * lam + 1, F.lit(0.0)), 1 / lam)


def _power_parts(u: Column, lam: float) -> tuple[Column, Column, Column]:
    """(e^(lam u) - 1) / lam and its first and second derivative by the exponent; by series where lam u is small."""
    w = u * lam
    small = F.abs(w) < 1e-2
    e = F.exp(w)
    value = u * F.when(small, 1 + w / 2 + w * w / 6 + w * w * w / 24 + w * w * w * w / 120).otherwise(F.try_divide(e - 1, w))
    first = u * u * F.when(small, 0.5 + w / 3 + w * w / 8 + w * w * w / 30 + w * w * w * w / 144).otherwise(F.try_divide(w * e - e + 1, w * w))
    second = u * u * u * F.when(small, 1 / 3 + w / 4 + w * w / 10 + w * w * w / 36 + w * w * w * w / 168).otherwise(F.try_divide(w * w * e - 2 * w * e + 2 * e - 2, w * w * w))
    return value, first, second


def yeo_johnson(x: Column, lam: float) -> Column:
    """The power transform of any number: that of x + 1 where x is not negative, else less that of 1 - x with the exponent 2 - lam."""
    return F.when(x >= 0, _power_parts(F.log1p(F.greatest(x, F.lit(0.0))), lam)[0]).when(x < 0, -_power_parts(F.log1p(F.greatest(-x, F.lit(0.0))), 2 - lam)[0])


@dataclass(frozen=True)
class PowerFit:
    """A power transform of greatest likelihood: ``box-cox`` or ``yeo-johnson``, its exponent, and what standardises its values."""

    kind: str
    lam: float
    mean: float
    std: float

    def column(self, x: Column) -> Column:
        value = _power_parts(F.ln(x), self.lam)[0] if self.kind == "box-cox" else yeo_johnson(x, self.lam)
        return (value - self.mean) / self.std


def fit_power(df: DataFrame, x: str, tolerance: float = 1e-8, steps: int = 60, reach: float = 8.0) -> PowerFit | None:
    """The fit of a column's numbers: Box-Cox if all are positive, Yeo-Johnson if any is not; None for fewer than two different numbers.

    Newton's steps on the profile likelihood, one aggregation each, kept inside a bracket that the slope's sign narrows.
    """
    own = df.select(number(F.col(x).cast("double")).alias("x")).where("x IS NOT NULL")
    ends = own.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends.lo is None or ends.lo == ends.hi:
        return None
    positive = ends.lo > 0
    u, below = F.ln("x"), F.col("x") < 0
    if not positive:
        u = F.log1p(F.abs("x"))
    weight = u if positive else F.when(below, -u).otherwise(u)
    lo, hi, lam = -reach, reach, 1.0
    mean = std = 0.0
    for _ in range(steps):
        t, t1, t2 = _power_parts(u, lam)
        if not positive:
            s, s1, s2 = _power_parts(u, 2 - lam)
            t, t1, t2 = F.when(below, -s).otherwise(t), F.when(below, s1).otherwise(t1), F.when(below, -s2).otherwise(t2)
        rows = own.select(weight.alias("w"), t.alias("t"), t1.alias("a"), t2.alias("b"))
        r = rows.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.avg("t").alias("t"), F.stddev_pop("t").alias("std"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.covar_pop("t", "a").alias("ta"), F.covar_pop("t", "b").alias("tb"), F.var_pop("a").alias("aa")).first()
        mean, std = r.t, r["std"]
        var, var1, var2 = std**2, 2 * r.ta, 2 * (r.aa + r.tb)
        slope = r.w - r.n / 2 * var1 / var
        curve = -r.n / 2 * (var2 / var - (var1 / var) ** 2)
        lo, hi = (lam, hi) if slope > 0 else (lo, lam)
        step = lam - slope / curve if curve < 0 else math.nan
        nxt = step if lo < step < hi else (lo + hi) / 2
        if abs(nxt - lam) <= tolerance:
            break
        lam = nxt
    return PowerFit("box-cox" if positive else "yeo-johnson", lam, mean, std)


def uniform(*keys: Column) -> Column:
    """A reproducible number in [0, 1) from integer keys, by arithmetic that other engines share."""
    mixed = F.lit(12345).cast("long")
    for k in keys:
        mixed = (mixed * 31 + k.cast("long") * 7919 + 104729) % 1000003
        mixed = (mixed * 48271) % 2147483647
    return mixed / 2147483647.0


def uniform_sql(*keys: str) -> str:
    mixed = "12345::BIGINT"
    for k in keys:
        mixed = f"(((({mixed} * 31 + ({k})::BIGINT * 7919 + 104729) % 1000003) * 48271) % 2147483647)"
    return f"({mixed} / 2147483647e0)"


def sample_histogram(df: DataFrame, u: str, edges: Sequence[float], counts: Sequence[int], out: str) -> DataFrame:
    """``out``: the value at which the histogram's cumulative share reaches ``u``, even within a bin."""
    from .interp import interpolate

    share = np.concatenate([[0], np.cumsum(counts)]) / sum(counts)
    keep = np.concatenate([[True], np.diff(share) > 0])
    keep[0] = True
    first = int(np.flatnonzero(np.diff(share) > 0)[0])
    keep[:first], keep[first] = False, True
    return interpolate(df, u, share[keep].tolist(), np.asarray(edges)[keep].tolist(), out)


def smoothed_density(df: DataFrame, x: Column, y: Column, x_edges: Sequence[float], y_edges: Sequence[float], sigma: float = 1.0) -> DataFrame:
    """(ix, iy, density): counts on a grid, smoothed by a Gaussian along one axis and then the other."""
    from .binning import bin_of

    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    table = df.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(range(-reach, reach + 1), w / w.sum(), strict=True)], "d int, w double")
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    counts = df.select(bin_of(x, x_edges, True).alias("ix"), bin_of(y, y_edges, True).alias("iy")).where("ix IS NOT NULL AND iy IS NOT NULL").groupBy("ix", "iy").agg(F.count("*").cast("double").alias("v"))
    for axis, n in (("ix", nx), ("iy", ny)):
        other = "iy" if axis == "ix" else "ix"
        spread = counts.crossJoin(F.broadcast(table)).withColumn(axis, F.col(axis) + F.col("d")).where(F.col(axis).between(0, n - 1))
        counts = spread.groupBy(axis, other).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return counts.select("ix", "iy", F.col("v").alias("density"))
