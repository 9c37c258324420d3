"""Luminosity functions on a redshift x luminosity grid, by two estimators, with completeness inside the volume integrals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.curves import CurveFit
from ..sources.storage import stored
from .binning import bin_of
from .cosmology import Grid
from .interp import interpolate

#: Flux cut (Jy), survey and whole sky (square degrees), and the published completeness (flux in mJy, share).
FLUX_CUT_JY, SKY_AREA, WHOLE_SKY = 1.1e-3, 5700.0, 41253.0
#: The spectral index of the k-correction.
ALPHA = -0.7
PUBLISHED_FLUX = (0.20, 0.22, 0.24, 0.27, 0.30, 0.34, 0.38, 0.42, 0.46, 0.52, 0.58, 0.64, 0.72, 0.80, 0.88, 0.98, 1.10, 1.19, 1.25)
PUBLISHED_SHARE = (0.0, 0.015625, 0.015625, 0.03125, 0.0625, 0.125, 0.1875, 0.28125, 0.34375, 0.46875, 0.53125, 0.625, 0.71875, 0.78125, 0.8125, 0.875, 0.90625, 0.96875, 1.0)


def completeness(df: DataFrame, flux_jy: str, resolved: Column, fit: CurveFit, out: str, published: bool = True, shift_mjy: float = 0.0) -> DataFrame:
    """``out``: the fitted curve for resolved sources, the published table or a step for the others, 0 at or below the cut."""
    wide = df.withColumn("_mjy", F.col(flux_jy) * 1000)
    wide = interpolate(wide, "_mjy", PUBLISHED_FLUX, PUBLISHED_SHARE, "_table") if published else wide.withColumn("_table", F.lit(1.0))
    value = F.when(resolved, fit.column(F.col("_mjy"), shift_mjy)).otherwise(F.col("_table"))
    return wide.withColumn(out, F.when(F.col(flux_jy) > FLUX_CUT_JY, value).otherwise(F.lit(0.0))).drop("_mjy", "_table")


def with_luminosity(sources: DataFrame, grid: Grid, flux_jy: str = "flux_jy", z: str = "z", out: str = "lum") -> DataFrame:
    """Sources with a positive flux and redshift, and their luminosity."""
    good = sources.where(F.coalesce((sky.number(F.col(flux_jy)) > 0) & (sky.number(F.col(z)) > 0), F.lit(False)))
    far = interpolate(good, z, grid.z, grid.distance, "_d")
    return far.withColumn(out, sky.luminosity(F.col(flux_jy), F.col("_d"), sky.k_correction(F.col(z)))).drop("_d")


def cells(spark: SparkSession, z_edges: Sequence[float], log_l_edges: Sequence[float], grid: Grid) -> DataFrame:
    """(iz, il, z_lo, z_hi, l_lo, l_hi, v_lo, v_hi) of the whole grid: a table of fixed size."""
    import numpy as np

    v = np.interp(z_edges, grid.z, grid.volume).tolist()
    rows = [(i, j, float(z_edges[i]), float(z_edges[i + 1]), float(log_l_edges[j]), float(log_l_edges[j + 1]), v[i], v[i + 1]) for i in range(len(z_edges) - 1) for j in range(len(log_l_edges) - 1)]
    return spark.createDataFrame(rows, "iz int, il int, z_lo double, z_hi double, l_lo double, l_hi double, v_lo double, v_hi double")


def binned(sources: DataFrame, z_edges: Sequence[float], log_l_edges: Sequence[float], z: str = "z", lum: str = "lum") -> DataFrame:
    return sources.withColumns({"iz": bin_of(F.col(z), z_edges), "il": bin_of(F.log10(lum), log_l_edges)}).where("iz IS NOT NULL AND il IS NOT NULL")


def counts(sources: DataFrame, grid_cells: DataFrame, z_edges: Sequence[float], log_l_edges: Sequence[float]) -> DataFrame:
    """The grid with the numbers of all, resolved and other sources."""
    got = binned(sources, z_edges, log_l_edges).groupBy("iz", "il").agg(F.count("*").alias("n"), F.count_if("resolved").alias("n_resolved"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = grid_cells.join(got, ["iz", "il"], "left").withColumns({"n": zero("n"), "n_resolved": zero("n_resolved")})
    return out.withColumn("n_other", F.col("n") - F.col("n_resolved"))


def integrals(grid_cells: DataFrame, grid: Grid, fit: CurveFit, n_points: int = 256, published: bool = True) -> DataFrame:
    """(iz, il, i_resolved, i_other): completeness times volume times log-luminosity width, on a fixed two-dimensional sequence of points."""
    points = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")
    spread = grid_cells.select("iz", "il", "v_lo", "v_hi", "l_lo", "l_hi", points)
    u = (F.col("i") + 0.5) / n_points
    t = F.col("i") * 0.6180339887498949
    spread = spread.withColumns({"v": F.col("v_lo") + u * (F.col("v_hi") - F.col("v_lo")), "lum": F.pow(F.lit(10.0), F.col("l_lo") + (t - F.floor(t)) * (F.col("l_hi") - F.col("l_lo")))})
    at = interpolate(interpolate(spread, "v", grid.volume, grid.z, "z"), "z", grid.z, grid.distance, "d")
    at = at.withColumn("flux", sky.flux_of(F.col("lum"), F.col("d"), sky.k_correction(F.col("z"))))
    both = completeness(completeness(at, "flux", F.lit(True), fit, "c_res", published), "flux", F.lit(False), fit, "c_oth", published)
    size = (F.first("v_hi") - F.first("v_lo")) * (F.first("l_hi") - F.first("l_lo"))
    return both.groupBy("iz", "il").agg((F.avg("c_res") * size).alias("i_resolved"), (F.avg("c_oth") * size).alias("i_other"))


def refined_integrals(grid_cells: DataFrame, grid: Grid, fit: CurveFit, tolerance: float = 2e-3, side: int = 4, cut: int = 4, rounds: int = 6, published: bool = True) -> DataFrame:
    """(iz, il, i_resolved, i_other, error, n_points): the same integrals with a known error, by refinement where it is needed.

    A part of a cell is integrated by ``side`` x ``side`` midpoints in redshift and log luminosity, each with the volume around it: near
    redshift 0, where all but a thin shell of the volume is far away, steps in volume would miss what can be seen.  In each round every open part is cut into ``cut`` x ``cut``; where their sum
    is within the part's tolerance of its own integral it is taken, elsewhere they are open in the next round.  The tolerance is a share of the
    cell's integral that falls with the root of the part's area, so the parts along a step of the completeness, of which there are twice as many at
    half the width, add up to it.  ``error`` is the sum of these differences, and of the last ones where ``rounds`` are used up, as a share of the
    cell's integral (the larger share of both kinds).
    """
    whole = grid_cells.select("iz", "il", F.col("z_lo").alias("v0"), F.col("z_hi").alias("v1"), F.col("l_lo").alias("l0"), F.col("l_hi").alias("l1"), F.lit(1.0).alias("share")).distinct()

    def evaluated(parts: DataFrame, *keys: str) -> DataFrame:
        """Integrals of parts, a batch of them at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = (np.arange(side) + 0.5) / side
            for b in batches:
                z0, z1, l0, l1 = (b.column(b.schema.get_field_index(c)).to_numpy()[:, None] for c in ("v0", "v1", "l0", "l1"))
                z, edges = z0 + step * (z1 - z0), z0 + np.arange(side + 1) / side * (z1 - z0)
                volume = np.diff(np.interp(edges, grid.z, grid.volume), axis=1)
                distance = np.interp(z, grid.z, grid.distance)
                with np.errstate(divide="ignore"):
                    seen = ((1 + z) ** (1 - ALPHA) / (4 * math.pi * 1e-26 * distance**2))[:, :, None] * (10 ** (l0 + step * (l1 - l0)))[:, None, :]
                weight = volume[:, :, None] * ((l1 - l0) / side)[:, :, None] * np.ones(side)
                good = np.isfinite(seen) & (seen > FLUX_CUT_JY)
                mjy = np.where(good, seen * 1000, 1.0)
                res = np.where(good, fit.values(mjy), 0.0)
                oth = np.where(good, np.interp(mjy, PUBLISHED_FLUX, PUBLISHED_SHARE) if published else 1.0, 0.0)
                sums = [pa.array((x * weight).sum(axis=(1, 2))) for x in (res, oth, np.ones_like(oth))]
                yield pa.RecordBatch.from_arrays([*b.columns, *sums], [*b.schema.names, "res", "oth", "size"])

        own = parts.select(*keys)
        return own.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", res double, oth double, size double")

    part = ["iz", "il", "v0", "v1", "l0", "l1", "share"]
    open_ = stored(evaluated(whole, *part), "cells")
    # the scales of a cell's error: its integrals, or a millionth of its size where nothing is seen
    scale = open_.select("iz", "il", *[F.greatest(c, F.col("size") * 1e-6).alias(f"s_{c}") for c in ("res", "oth")])
    done = None
    for i in range(rounds):
        border = lambda c, k: F.col(f"{c}0") + k / cut * (F.col(f"{c}1") - F.col(f"{c}0"))
        quarter = [F.struct(border("v", a).alias("a"), border("v", a + 1).alias("b"), border("l", c).alias("c"), border("l", c + 1).alias("d")) for a in range(cut) for c in range(cut)]
        own = [F.col(c).alias(f"p_{c}") for c in ("v0", "v1", "l0", "l1", "res", "oth")]
        pieces = open_.select("iz", "il", *own, F.col("share"), F.explode(F.array(*quarter)).alias("q"))
        small = pieces.select("iz", "il", *[f"p_{c}" for c in ("v0", "v1", "l0", "l1", "res", "oth")], (F.col("share") / cut**2).alias("share"), *[F.col(f"q.{x}").alias(y) for x, y in zip("abcd", ("v0", "v1", "l0", "l1"), strict=True)])
        names = [f"p_{c}" for c in ("v0", "v1", "l0", "l1", "res", "oth")]
        children = stored(evaluated(small, *part, *names), "parts")
        sums = children.groupBy("iz", "il", *names).agg(F.sum("res").alias("res"), F.sum("oth").alias("oth"), F.sum("share").alias("share"))
        off = {f"off_{c}": F.abs(F.col(c) - F.col(f"p_{c}")) for c in ("res", "oth")}
        near = F.greatest(F.col("off_res") / F.col("s_res"), F.col("off_oth") / F.col("s_oth")) <= tolerance / 2 * F.sqrt("share")
        judged = sums.join(F.broadcast(scale), ["iz", "il"]).withColumns(off).withColumn("good", near & F.lit(i > 0))
        taken = judged.where("good" if i < rounds - 1 else "true").select("iz", "il", "res", "oth", "off_res", "off_oth", F.lit((cut * side) ** 2).alias("n"))
        spent = judged.where("NOT good").select("iz", "il", *[F.lit(0.0).alias(c) for c in ("res", "oth", "off_res", "off_oth")], F.lit((cut * side) ** 2).alias("n")) if i < rounds - 1 else taken.limit(0)
        total = [F.sum(c).alias(c) for c in ("res", "oth", "off_res", "off_oth", "n")]
        summed = taken.unionByName(spent).groupBy("iz", "il").agg(*total)
        done = stored(summed if done is None else done.unionByName(summed).groupBy("iz", "il").agg(*total), "done")
        left = judged.where("NOT good").select("iz", "il", *names[:4])
        open_ = children.join(left, ["iz", "il", *names[:4]], "left_semi").select(*part, "res", "oth")
        if i == rounds - 1 or left.isEmpty():
            break
    return done.select("iz", "il", F.col("res").alias("i_resolved"), F.col("oth").alias("i_other"), F.greatest(*[F.coalesce(F.try_divide(f"off_{c}", c), F.lit(0.0)) for c in ("res", "oth")]).alias("error"), F.col("n").alias("n_points"))


def page_carrera(counted: DataFrame, integral: DataFrame, sky_factor: float = SKY_AREA / WHOLE_SKY) -> DataFrame:
    """(iz, il, ..., phi, phi_err): numbers over integrals of both kinds; null where a bin has sources but no volume."""
    j = counted.join(integral, ["iz", "il"])
    one = lambda n, i: F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(n).cast("double"), F.when(F.col(i) > 0, F.col(i))))
    half = lambda n, i: F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.try_divide(F.sqrt(F.col(n)), F.when(F.col(i) > 0, F.col(i))))
    phi = (one("n_resolved", "i_resolved") + one("n_other", "i_other")) / sky_factor
    noise = F.pow(half("n_resolved", "i_resolved"), 2) + F.pow(half("n_other", "i_other"), 2)
    return j.withColumn("phi", phi).withColumn("phi_err", F.sqrt(noise / sky_factor**2 + F.pow(0.05 * F.col("phi"), 2)))


def impossible_bins(counted: DataFrame, integral: DataFrame) -> DataFrame:
    """Bins with sources whose kind has no volume there."""
    j = counted.join(integral, ["iz", "il"])
    return j.where(((F.col("n_resolved") > 0) & (F.col("i_resolved") <= 0)) | ((F.col("n_other") > 0) & (F.col("i_other") <= 0))).select("iz", "il", "n_resolved", "n_other", "i_resolved", "i_other")


def available_volume(sources: DataFrame, z_edges: Sequence[float], log_l_edges: Sequence[float], grid: Grid, fit: CurveFit, n_points: int = 64, steps: int = 64, published: bool = True) -> DataFrame:
    """Binned sources with ``va``: the completeness-weighted volume of their redshift bin at their own luminosity, times the bin's width.

    Completeness depends on the bin, the luminosity and the kind alone, so the integral is tabulated on ``steps`` luminosities a bin
    and interpolated: the table's size does not depend on the number of sources.
    """
    spark = sources.sparkSession
    table = cells(spark, z_edges, log_l_edges, grid)
    steps_of = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("s")
    grid_points = table.select("iz", "il", "v_lo", "v_hi", "l_lo", "l_hi", steps_of).withColumn("resolved", F.explode(F.array(F.lit(True), F.lit(False))))
    lum = F.pow(F.lit(10.0), F.col("l_lo") + F.col("s") / steps * (F.col("l_hi") - F.col("l_lo")))
    spread = grid_points.withColumn("lum", lum).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")).withColumn("v", F.col("v_lo") + (F.col("i") + 0.5) / n_points * (F.col("v_hi") - F.col("v_lo")))
    at = interpolate(interpolate(spread, "v", grid.volume, grid.z, "z"), "z", grid.z, grid.distance, "d")
    at = completeness(at.withColumn("flux", sky.flux_of(F.col("lum"), F.col("d"), sky.k_correction(F.col("z")))), "flux", F.col("resolved"), fit, "c", published)
    knots = at.groupBy("iz", "il", "resolved", "s").agg((F.avg("c") * (F.first("v_hi") - F.first("v_lo")) * (F.first("l_hi") - F.first("l_lo"))).alias("va"))
    lists = knots.groupBy("iz", "il", "resolved").agg(F.sort_array(F.collect_list(F.struct("s", "va"))).alias("k"))
    mine = binned(sources, z_edges, log_l_edges).join(F.broadcast(table.select("iz", "il", "l_lo", "l_hi")), ["iz", "il"]).join(F.broadcast(lists), ["iz", "il", "resolved"])
    x = (F.log10("lum") - F.col("l_lo")) / (F.col("l_hi") - F.col("l_lo")) * steps
    i = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(x).cast("int")))
    a, b = F.element_at("k", i + 1)["va"], F.element_at("k", i + 2)["va"]
    return mine.withColumn("va", a + (x - i) * (b - a)).drop("k", "l_lo", "l_hi")


def one_over_va(sources: DataFrame, grid_cells: DataFrame, sky_factor: float = SKY_AREA / WHOLE_SKY) -> DataFrame:
    """(iz, il, n, phi, phi_err, n_no_volume): sums of 1/Va; sources without volume are counted apart, an empty bin is 0."""
    inv = F.try_divide(F.lit(1.0), F.when(F.col("va") > 0, F.col("va")))
    got = sources.groupBy("iz", "il").agg(F.count("*").alias("n"), F.sum(inv).alias("s"), F.sqrt(F.sum(inv * inv)).alias("e"), F.count_if(inv.isNull()).alias("n_no_volume"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return grid_cells.select("iz", "il").join(got, ["iz", "il"], "left").select("iz", "il", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (zero("s") / sky_factor).alias("phi"), (zero("e") / sky_factor).alias("phi_err"), F.coalesce("n_no_volume", F.lit(0)).cast("long").alias("n_no_volume"))
