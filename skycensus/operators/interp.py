"""Piecewise-linear interpolation of a column over a table of knots, with the ends held."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def segment(x: Column, knots: Sequence[float]) -> Column:
    """The number of the segment (1 to len - 1) that holds ``x``; ends are held.

    Evenly spaced knots take a closed form that is checked against the knots on either side; others count the knots below.
    """
    n = len(knots)
    step = (knots[-1] - knots[0]) / (n - 1)
    even = all(abs(knots[i] - (knots[0] + i * step)) <= 1e-9 * abs(step) for i in range(n))
    if not even:
        return F.greatest(F.lit(1), F.least(F.lit(n - 1), F.size(F.filter(_literal(knots), lambda k: k <= x))))
    guess = F.greatest(F.lit(1), F.least(F.lit(n - 1), (F.floor((x - knots[0]) / step) + 1).cast("int")))
    table = _literal(knots)
    lower, upper = F.element_at(table, guess), F.element_at(table, guess + 1)
    return F.when((x < lower) & (guess > 1), guess - 1).when((x >= upper) & (guess < n - 1), guess + 1).otherwise(guess)


def interpolate(df: DataFrame, x: str, knots: Sequence[float], values: Sequence[float], out: str) -> DataFrame:
    """``df`` with ``out``: the knots' segments are a table of fixed size, equi-joined on the segment's number."""
    if len(knots) != len(values) or len(knots) < 2:
        raise ValueError("two knots or more, and a value for each")
    rows = [(i + 1, float(knots[i]), float(knots[i + 1]), float(values[i]), float(values[i + 1])) for i in range(len(knots) - 1)]
    table = df.sparkSession.createDataFrame(rows, "_seg int, _x0 double, _x1 double, _y0 double, _y1 double")
    at = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), F.col(x)))
    keyed = df.withColumn("_seg", segment(F.col(x), knots))
    line = F.col("_y0") + (at - F.col("_x0")) * ((F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0")))
    return keyed.join(F.broadcast(table), "_seg", "left").withColumn(out, F.when(F.isnan(x), F.lit(None)).otherwise(line)).drop("_seg", "_x0", "_x1", "_y0", "_y1")


def interp_sql(x: str, knots: Sequence[float], values: Sequence[float]) -> str:
    """The same for DuckDB, as an expression."""
    xs, ys = ("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in t) + "]" for t in (knots, values))
    n = len(knots)
    i = f"greatest(1, least({n - 1}, len(list_filter({xs}, lambda k: k <= {x}))))"
    at = f"greatest({float(knots[0])!r}::DOUBLE, least({float(knots[-1])!r}::DOUBLE, {x}))"
    return f"({ys}[{i}] + ({at} - {xs}[{i}]) * (({ys}[{i} + 1] - {ys}[{i}]) / ({xs}[{i} + 1] - {xs}[{i}])))"
