"""Bins, counts in bins, and histograms; grids are complete, with empty bins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    return [10.0**e for e in np.linspace(np.log10(lo), np.log10(hi), n).tolist()]


def linear_edges(lo: float, hi: float, n: int) -> list[float]:
    return np.linspace(lo, hi, n).tolist()


def bin_of(x: Column, edges: Sequence[float], closed: bool = False) -> Column:
    """The bin from 0 of half-open bins, null outside; ``closed`` adds the last edge to the last bin."""
    n = len(edges) - 1
    found = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= x)) - 1
    inside = (x >= edges[0]) & ((x <= edges[-1]) if closed else (x < edges[-1])) & ~F.isnan(x)
    return F.when(inside, F.least(found, F.lit(n - 1)))


def bins(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    """(bin, lo, hi) of all bins: a table of fixed size."""
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return df.sparkSession.createDataFrame(rows, "bin int, lo double, hi double")


def per_bin(df: DataFrame, x: Column, edges: Sequence[float], *aggs: Column, closed: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Aggregates for each bin (and each value of ``by``); bins without rows have nulls."""
    got = df.withColumn("bin", bin_of(x, edges, closed)).where("bin IS NOT NULL").groupBy(*by, "bin").agg(*aggs)
    every = bins(df, edges)
    if by:
        every = df.select(*by).distinct().withColumn("_b", F.explode(F.array(*(F.lit(i) for i in range(len(edges) - 1))))).join(F.broadcast(every), F.col("_b") == F.col("bin")).drop("_b")
    return every.join(got, [*by, "bin"], "left")


def completeness_per_bin(trials: DataFrame, edges: Sequence[float], flux: str = "mock_flux", detected: str = "detectable", by: Sequence[str] = ()) -> DataFrame:
    """(bin, lo, hi, n, n_detected, completeness): detected over all, 0 in an empty bin."""
    got = per_bin(trials, F.col(flux), edges, F.count("*").alias("n"), F.count_if(F.col(detected)).alias("n_detected"), by=by)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return got.withColumns({"n": zero("n"), "n_detected": zero("n_detected")}).withColumn("completeness", F.coalesce(F.try_divide("n_detected", "n"), F.lit(0.0)))


def histogram(df: DataFrame, x: Column, edges: Sequence[float], mode: str = "count") -> DataFrame:
    """(bin, lo, hi, value, error) with Poisson errors; the last bin is closed.  mode: count, density or relative."""
    got = per_bin(df, x, edges, F.count("*").alias("n"), closed=True).withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    all_ = got.agg(F.sum("n").alias("total"))
    unit = {"count": F.lit(1.0), "density": F.col("total") * (F.col("hi") - F.col("lo")), "relative": F.col("total")}[mode]
    return got.crossJoin(F.broadcast(all_)).select("bin", "lo", "hi", F.coalesce(F.try_divide("n", unit), F.lit(0.0)).alias("value"), F.coalesce(F.try_divide(F.sqrt("n"), unit), F.lit(0.0)).alias("error"))
