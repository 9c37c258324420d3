"""Source classes from magnitudes and luminosities, and filter funnels in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from .cosmology import MPC_M, Grid
from .interp import interpolate


def absolute_magnitude(df: DataFrame, grid: Grid, out: str = "abs_w3") -> DataFrame:
    """``out``: the k-corrected absolute magnitude in band 3; null where z or a magnitude is missing or not positive."""
    far = interpolate(df.withColumn("_z", sky.number(F.col("z_best"))), "_z", grid.z, grid.distance, "_d")
    w2, w3 = sky.number(F.col("mag_w2")), sky.number(F.col("mag_w3"))
    slope = F.ln(sky.mag_to_flux(w3, 3) / sky.mag_to_flux(w2, 2)) / -math.log(sky.BAND_WAVELENGTH[2] / sky.BAND_WAVELENGTH[3])
    parsec = F.col("_d") / (MPC_M / 1e6)
    value = w3 - 5 * (F.log10(parsec) - 1) - sky.k_correction(F.col("_z"), slope, magnitudes=True)
    return far.withColumn(out, F.when((F.col("_z") > 0) & (w3 > 0) & (w2 > 0), value)).drop("_z", "_d")


def _sure(c: Column) -> Column:
    """A condition with a missing part is false."""
    return F.coalesce(c, F.lit(False))


def base_gate() -> Column:
    """Flux and redshift above their cuts, magnitudes and luminosity present."""
    there = sky.number(F.col("mag_w1")).isNotNull() & sky.number(F.col("mag_w2")).isNotNull() & sky.number(F.col("mag_w3")).isNotNull() & sky.number(F.col("l_144")).isNotNull()
    return _sure((sky.number(F.col("total_flux")) > sky.FLUX_CUT_MJY) & (sky.number(F.col("z_best")) > sky.Z_CUT) & there)


def classified(df: DataFrame, grid: Grid, exclusive: bool = False) -> DataFrame:
    """``in_sample``, ``sfg``, ``rqq``, ``rlagn`` and ``keep`` (not positively a contaminant).

    Without ``exclusive`` a source whose band-3 error is missing (an upper limit) is in no contaminant class.
    """
    m, lum = F.col("abs_w3"), F.col("l_144")
    sfg = (lum < F.pow(F.lit(10.0), sky.SFG_OFFSET - m / 2.5)) & (lum < 10**sky.SFG_LOG_L)
    rqq = (lum < F.pow(F.lit(10.0), sky.RQQ_OFFSET + (-m - 27.0) * sky.RQQ_SLOPE)) & (m < sky.RQQ_MAG) & (lum >= 10**sky.SFG_LOG_L)
    known = F.lit(True) if exclusive else sky.number(F.col("magerr_w3")).isNotNull()
    out = absolute_magnitude(df, grid).withColumn("in_sample", base_gate())
    out = out.withColumns({"sfg": F.col("in_sample") & known & _sure(sfg), "rqq": F.col("in_sample") & known & _sure(rqq)})
    return out.withColumns({"rlagn": F.col("in_sample") & ~F.col("sfg") & ~F.col("rqq"), "keep": ~F.col("sfg") & ~F.col("rqq")})


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``failed_at``: the number (from 1) of the first condition that a row fails, null for a row that passes all."""
    tests = [F.when(~_sure(c), F.lit(i)) for i, (_, c) in enumerate(steps, 1)]
    return df.withColumn("failed_at", F.coalesce(*tests))


def funnel_report(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, removed, remaining) of one aggregation; step 0 is the input."""
    one = funnel(df, steps)
    aggs = [F.count("*").alias("n0"), *(F.count_if(F.col("failed_at") == i).alias(f"n{i}") for i in range(1, len(steps) + 1))]
    row = one.agg(*aggs)
    left = F.col("n0")
    parts = [F.struct(F.lit(0).alias("step"), F.lit("input").alias("name"), F.lit(0).cast("long").alias("removed"), left.alias("remaining"))]
    for i, (name, _) in enumerate(steps, 1):
        left = left - F.col(f"n{i}")
        parts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("removed"), left.alias("remaining")))
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
