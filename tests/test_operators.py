"""Operators on hand-made tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycensus.functions import sky
from skycensus.operators import binning, cosmology, dist, fitting, imaging, select, sizing, skyjoin
from skycensus.operators.interp import interpolate


def components(spark, rows):
    at = [(p, 180 + dra / 3600 / math.cos(math.radians(40)), 40 + ddec / 3600, peak, 6.0, 6.0, 0.0) for p, dra, ddec, peak in rows]
    return spark.createDataFrame(at, "parent string, ra double, dec double, peak double, maj double, min double, pa double")


def source(spark):
    return spark.createDataFrame([(1, "S", 180.0, 40.0, 0.1, "ID")], "source_id long, source_name string, ra double, dec double, isl_rms double, id_name string")


def test_neighbour_is_flagged(spark):
    r = skyjoin.foreign_flags(source(spark), components(spark, [("S", 0, 0, 1.0), ("N", 30, 0, 1.0), ("Far", 80, 0, 9.0)])).first()
    assert (r.n_foreign_components, r.n_foreign_detected, r.brightest_foreign_parent, r.foreign_contaminant) == (1, 1, "N", True)
    assert r.brightest_foreign_snr == pytest.approx(10.0)


def test_faint_neighbour_needs_a_lower_cut(spark):
    comps = components(spark, [("S", 0, 0, 1.0), ("N", 30, 0, 0.3)])
    assert not skyjoin.foreign_flags(source(spark), comps).first().foreign_contaminant
    assert skyjoin.foreign_flags(source(spark), comps, sigma=2.0).first().foreign_contaminant


def test_source_without_neighbours_keeps_its_row(spark):
    r = skyjoin.foreign_flags(source(spark), components(spark, [("S", 0, 0, 1.0)])).first()
    assert (r.n_foreign_components, r.brightest_foreign_parent, r.foreign_contaminant) == (0, "", False)


def test_wide_component_reaches_over_cells(spark):
    comps = components(spark, [("Wide", 900, 0, 1.0)]).withColumns({"maj": F.lit(2000.0), "min": F.lit(2000.0)})
    assert skyjoin.foreign_flags(source(spark), comps).first().n_foreign_components == 1


def test_neighbours_equal_all_pairs(spark):
    """Every pair once: around RA 0, near the pole, with wide components and with a repeated row."""
    rng = np.random.default_rng(5)
    places = lambda n: [(float(ra), float(dec)) for dec0 in (0.0, 45.0, 89.4, -89.97) for ra, dec in zip((rng.normal(0, 0.1, n) / max(np.cos(np.radians(dec0)), 0.01)) % 360, np.clip(rng.normal(dec0, 0.1, n), -90, 90), strict=True)]
    src = spark.createDataFrame([(i, f"S{i}", *p, 0.1) for i, p in enumerate(places(40))], "source_id long, source_name string, ra double, dec double, isl_rms double")
    rows = [(f"C{i}", *p, 1.0, float(a), float(a) / 2, 30.0) for i, (p, a) in enumerate(zip(places(60), np.where(rng.random(240) < 0.2, rng.uniform(200, 3000, 240), 8.0), strict=True))]
    comps = spark.createDataFrame([*rows, rows[0]], "parent string, ra double, dec double, peak double, maj double, min double, pa double")
    got = skyjoin.neighbours(src, comps).groupBy("source_id", "parent").count()
    dx, dy = sky.ellipse_halfwidths(F.col("maj"), F.col("min"), F.col("pa"))
    both = src.crossJoin(comps.select("parent", F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"), dx.alias("dx"), dy.alias("dy")))
    hit = (F.abs(sky.ra_offset(F.col("c_ra"), F.col("ra"), F.col("dec"))) <= 60 + F.col("dx")) & (F.abs((F.col("c_dec") - F.col("dec")) * 3600.0) <= 60 + F.col("dy"))
    want = both.where(hit).groupBy("source_id", "parent").count()
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(got) == pairs(want) != []


@pytest.mark.parametrize(("offset", "cropped"), [(58, True), (40, False), (80, True)])
def test_cropped(spark, offset, cropped):
    assert skyjoin.cropped_flags(source(spark), components(spark, [("S", 0, 0, 1.0), ("S", offset, 0, 1.0)])).first().cropped is cropped


def test_bright_component_is_cropped_at_its_contour(spark):
    comps = components(spark, [("S", 55, 0, 100.0)])
    assert not skyjoin.cropped_flags(source(spark), comps).first().cropped
    assert skyjoin.cropped_flags(source(spark), comps, boundary_sigma=3.0).first().cropped


def test_completeness_per_bin(spark):
    t = spark.createDataFrame([(0.5, True), (0.5, True), (0.5, False), (1.5, True), (1.5, False), (2.5, True)], "mock_flux double, detectable boolean")
    got = [r.completeness for r in binning.completeness_per_bin(t, [0, 1, 2, 3, 4]).orderBy("bin").collect()]
    assert got == [pytest.approx(2 / 3), 0.5, 1.0, 0.0]


def test_last_histogram_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    assert [r.value for r in binning.histogram(df, F.col("x"), [0, 1, 2]).orderBy("bin").collect()] == [1.0, 2.0]


def test_interpolation_matches_numpy(spark):
    x, y = [0.0, 1.0, 3.0, 7.0], [0.0, 2.0, 1.0, 5.0]
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.5, 1, 2, 3, 6.5, 7, 9)], "x double")
    rows = interpolate(df, "x", x, y, "y").collect()
    assert all(r.y == pytest.approx(np.interp(r.x, x, y)) for r in rows)


def test_distances_of_a_flat_universe():
    g = cosmology.grid()
    at = np.interp(1.0, g.z, g.distance) / cosmology.MPC_M
    assert at == pytest.approx(6607, rel=2e-3)


def test_funnel(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0), (4, 2.0)], "id int, x double")
    rows = select.funnel_report(df, [("small", F.col("x") < 5), ("odd", F.col("id") % 2 == 1)]).orderBy("step").collect()
    assert [(r.removed, r.remaining) for r in rows] == [(0, 4), (2, 2), (1, 1)]


def test_classes(spark):
    cols = "total_flux double, z_best double, resolved boolean, l_144 double, mag_w1 double, mag_w2 double, mag_w3 double, magerr_w3 double"
    nan = float("nan")
    rows = [(50.0, 0.5, True, 1e22, 17.0, 15.0, 13.0, 0.1), (50.0, 0.5, True, 1e27, 17.0, 15.0, 13.0, 0.1), (50.0, 0.5, True, 1e22, 17.0, 15.0, 13.0, nan), (50.0, nan, True, 1e22, 17.0, 15.0, 13.0, 0.1)]
    got = select.classified(spark.createDataFrame(rows, cols), cosmology.grid()).select("sfg", "rqq", "rlagn", "keep").collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, False, True, True), (False, False, True, True), (False, False, False, True)]


@pytest.mark.parametrize("shift", [0.0, 2.5])
def test_wasserstein_of_a_shift(spark, shift):
    rows = [("a", float(v)) for v in range(50)] + [("b", v + shift) for v in range(50)]
    df = spark.createDataFrame(rows, "side string, v double")
    assert dist.wasserstein(df, "v", "side", "a", "b", 4).first().w1 == pytest.approx(shift)


def test_kernel_distance_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 2)), rng.normal(0.5, 1, (25, 2))
    df = spark.createDataFrame([("a", *map(float, r)) for r in a] + [("b", *map(float, r)) for r in b], "side string, x double, y double")
    k = lambda p, q: (p @ q.T / 2 + 1) ** 3
    within = lambda p: (k(p, p).sum() - np.trace(k(p, p))) / (len(p) * (len(p) - 1))
    want = within(a) + within(b) - 2 * k(a, b).mean()
    assert dist.kernel_distance(df, ["x", "y"], "side", "a", "b").first().mmd2 == pytest.approx(want, rel=1e-9)


def test_best_lambda_of_a_lognormal(spark):
    v = np.exp(np.random.default_rng(2).normal(size=2000))
    lam, m, s = dist.best_lambda(spark.createDataFrame([(float(x),) for x in v], "x double"), "x")
    assert abs(lam) < 0.1 and s == pytest.approx(1, abs=0.1)


def test_fit_recovers_a_curve(spark):
    x = np.linspace(-1, 1, 15)
    y = 1 / (1 + np.exp(-5 * x)) + np.random.default_rng(3).normal(0, 0.01, 15)
    df = spark.createDataFrame([("c", float(a), float(b), 0.02) for a, b in zip(x, y)] + [("c", 0.1, float("nan"), 0.02), ("c", 0.2, 0.5, 0.0), ("few", 0.0, 0.5, 0.1)], "s string, x double, y double, e double")
    got = {r.s: r for r in fitting.fit_curves(df, ["s"], "x", "y", "e", "sigmoid01").collect()}
    assert got["c"].popt == pytest.approx([0, 5], abs=0.3) and got["c"].n == 15 and got["few"].popt is None


def test_poisson_interval(spark):
    r = spark.createDataFrame([(0.0,), (10.0,)], "n double").select(fitting.poisson_interval("n").alias("i")).collect()
    assert r[0].i.lo == 0.0 and r[0].i.hi == pytest.approx(1.839, abs=2e-2)
    assert (r[1].i.lo, r[1].i.hi) == (pytest.approx(6.9, abs=0.1), pytest.approx(14.26, abs=0.1))


def test_sizes(spark):
    comps = spark.createDataFrame([("one", 10.0, 0.0, 14.4, 7.0, 0.0), ("two", 10.0, 0.0, 2.0, 2.0, 0.0), ("two", 11.0, 0.0, 2.0, 2.0, 0.0)], "parent string, ra double, dec double, maj double, min double, pa double")
    got = {r.parent: r["size"] for r in sizing.component_sizes(comps).collect()}
    assert got["one"] == pytest.approx(14.4) and got["two"] == pytest.approx(3602.2, rel=1e-3)


def test_hull_of_points_on_a_line():
    assert sizing.furthest(np.array([[0.0, 0], [1, 1], [2, 2]])) == pytest.approx(8.0)
    assert sizing.furthest(np.array([[1.0, 1.0]])) == 0.0


def test_islands():
    m = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 1]], bool)
    assert imaging.labels(m).max() == 4 and imaging.labels(m, corners=True).max() == 2


def test_failing_image_gives_its_error(spark):
    df = spark.createDataFrame([(1, 2, 2, [1.0] * 4), (2, 3, 3, [1.0] * 4)], "idx long, h int, w int, image array<double>")
    got = {r.idx: r for r in imaging.map_images(df, lambda m: (float(m.sum()),), {"s": "double"}).collect()}
    assert got[1].s == 4.0 and got[1].error is None and got[2].s is None and got[2].error


def test_injection_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, 4, 4, [0.1] * 16) for i in range(6)], "idx long, h int, w int, image array<double>")
    one, many = (sorted(map(tuple, imaging.inject(df.repartition(n), 3).collect())) for n in (1, 3))
    assert one == many and len(one) == 18
