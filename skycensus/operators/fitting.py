"""Weighted curve fits for each group, after aggregation: groups are a few dozen binned rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.curves import CURVES


def levenberg_marquardt(f: Callable[..., np.ndarray], x: np.ndarray, y: np.ndarray, sigma: np.ndarray, start: Sequence[float], lower: Sequence[float] | None = None, upper: Sequence[float] | None = None, rounds: int = 200, absolute: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """(parameters, covariance) of a least-squares fit inside a box; None if it does not settle or has too few points."""
    p = np.array(start, float)
    lo = np.full(len(p), -np.inf) if lower is None else np.array(lower, float)
    hi = np.full(len(p), np.inf) if upper is None else np.array(upper, float)
    if len(x) < len(p):
        return None
    residual = lambda q: (y - f(x, *q)) / sigma

    def slopes(q: np.ndarray) -> np.ndarray:
        out = []
        for i in range(len(q)):
            h = 1e-6 * max(1.0, abs(q[i]))
            a, b = q.copy(), q.copy()
            a[i], b[i] = a[i] + h, b[i] - h
            out.append((f(x, *a) - f(x, *b)) / (2 * h) / sigma)
        return np.column_stack(out)

    damp, r = 1e-3, residual(p)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            j = slopes(p)
            normal, down = j.T @ j, j.T @ r
            if not np.isfinite(normal).all():
                return None
            try:
                step = np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), down)
            except np.linalg.LinAlgError:
                return None
            trial = np.clip(p + step, lo, hi)
            new = residual(trial)
            if np.isfinite(new).all() and new @ new <= r @ r:
                done = abs(r @ r - new @ new) <= 1e-12 * max(1e-12, r @ r)
                p, r, damp = trial, new, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
        j = slopes(p)
        try:
            cov = np.linalg.inv(j.T @ j)
        except np.linalg.LinAlgError:
            cov = np.full((len(p), len(p)), np.inf)
    if not absolute:
        cov = cov * (r @ r / (len(x) - len(p))) if len(x) > len(p) else np.full_like(cov, np.inf)
    return p, cov


def fit_curves(df: DataFrame, by: Sequence[str], x: str, y: str, sigma: str, function: str = "sigmoid") -> DataFrame:
    """(by..., function, popt, pcov, n): a fit for each group; points that are missing or have no error are left out, a failed fit has nulls."""
    curve = CURVES[function]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        xs, ys, es = (group[c].to_numpy(float) for c in (x, y, sigma))
        ok = np.isfinite(xs) & np.isfinite(ys) & np.isfinite(es) & (es > 0)
        xs, ys, es = xs[ok], ys[ok], es[ok]
        half = float(xs[np.argmin(np.abs(ys - 0.5))]) if len(xs) else 0.0
        start = {"x0": half, "k": 5.0, "a": 1.0, "b": 0.0, "nu": 1.0, "sigma": 0.3}
        got = levenberg_marquardt(curve.numpy, xs, ys, es, [start[p] for p in curve.parameters])
        head = [group[c].iloc[0] for c in by]
        popt, pcov = (None, None) if got is None else (got[0].tolist(), got[1].tolist())
        return pd.DataFrame([[*head, function, popt, pcov, len(xs)]], columns=[*by, "function", "popt", "pcov", "n"])

    return df.select(*by, x, y, sigma).groupBy(*by).applyInPandas(one, f"{kinds}, function string, popt array<double>, pcov array<array<double>>, n int")


def gamma_quantile(shape: float, p: float) -> float:
    """The p-quantile of a gamma variable, by bisection on the regularised incomplete gamma function."""
    if shape <= 0:
        return 0.0

    def below(x: float) -> float:
        if x <= 0:
            return 0.0
        if x < shape + 1:  # series
            term = total = 1 / shape
            n = shape
            while abs(term) > 1e-16 * abs(total):
                n += 1
                term *= x / n
                total += term
            return total * math.exp(-x + shape * math.log(x) - math.lgamma(shape))
        tiny = 1e-300  # continued fraction
        b = x + 1 - shape
        c, d = 1 / tiny, 1 / b
        h = d
        for i in range(1, 10_000):
            a = -i * (i - shape)
            b += 2
            d = 1 / (a * d + b or tiny)
            c = b + a / c or tiny
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - math.exp(-x + shape * math.log(x) - math.lgamma(shape)) * h

    lo, hi = 0.0, max(10.0, shape * 4 + 50)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


@pandas_udf(StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())]))
def poisson_interval(n: pd.Series) -> pd.DataFrame:
    """The frequentist 68 % interval of a count that may be fractional; on binned rows only."""
    return pd.DataFrame({"lo": [gamma_quantile(v, 0.159) if v > 0 else 0.0 for v in n], "hi": [gamma_quantile(v + 1, 0.841) for v in n]})


def reduced_chi2(df: DataFrame, by: Sequence[str], y: Column, model: Column, error: Column, n_parameters: int) -> DataFrame:
    """(by..., n, chi2, reduced): squared deviations over the degrees of freedom."""
    term = F.pow((y - model) / error, 2)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(term).alias("chi2")).withColumn("reduced", F.try_divide("chi2", F.col("n") - n_parameters))


def evolving_log_density(x: np.ndarray, alpha: float, beta: float, log_c: float, log_star: float, density: float, luminosity: float) -> np.ndarray:
    """log10 of a double power law in luminosity whose density and characteristic luminosity grow as powers of 1 + z; rows (log L, z)."""
    grown = np.log10(1 + x[:, 1])
    off = x[:, 0] - log_star - luminosity * grown
    # log(10^a + 10^b) without overflow
    return log_c + density * grown - np.logaddexp(alpha * off * math.log(10), beta * off * math.log(10)) / math.log(10)


def joint_fit(bins: pd.DataFrame) -> pd.DataFrame:
    """(n, popt, perr) of ``evolving_log_density`` over all bins (log_l, z, y, err); nulls where the fit does not settle.

    The grid has a fixed number of bins, so they fit in one task whatever the number of sources.
    """
    good = bins[np.isfinite(bins[["log_l", "z", "y", "err"]]).all(axis=1)]
    x, y, err = good[["log_l", "z"]].to_numpy(float), good.y.to_numpy(float), np.maximum(good.err.to_numpy(float), 1e-3)
    got = None
    if len(good):
        start = [0.5, 1.5, float(y.max()), float(np.median(x[:, 0])), 0.0, 0.0]
        got = levenberg_marquardt(evolving_log_density, x, y, err, start, [-2, -2, -40, 20, -10, -10], [4, 4, 5, 30, 10, 10], absolute=True)
    if got is None:
        return pd.DataFrame([[len(good), None, None]], columns=["n", "popt", "perr"])
    return pd.DataFrame([[len(good), got[0].tolist(), np.sqrt(np.maximum(np.diag(got[1]), 0)).tolist()]], columns=["n", "popt", "perr"])
