"""Column expressions against values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skycensus.functions import curves, images, sky


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("x", "y"), [(0.0, 0.0), (0.5, 0.5204998778), (-1.0, -0.8427007929), (3.0, 0.9999779095)])
def test_erf(spark, x, y):
    assert one(spark, curves.erf(F.lit(x))) == pytest.approx(y, abs=2e-7)


def test_sigmoid_limits(spark):
    assert one(spark, curves.sigmoid(F.lit(1e9), 0.0, 5.0)) == 1.0
    assert one(spark, curves.sigmoid(F.lit(-1e9), 0.0, 5.0, 0.9, 0.05)) == pytest.approx(0.05)


def test_power_law_is_half_of_c_at_the_break(spark):
    assert one(spark, curves.double_power_law(F.lit(10.0**24.5), 0.6, 1.8, -5.5, 24.5)) == pytest.approx(10**-5.5 / 2)


def test_stored_fit(spark):
    fit = curves.CurveFit("sigmoid01", "log10", (0.0, 5.0))
    assert one(spark, fit.column(F.lit(1.0))) == pytest.approx(0.5)
    assert one(spark, fit.column(F.lit(0.0))) == 0.0
    assert one(spark, fit.column(F.lit(-1.0))) is None
    with pytest.raises(ValueError):
        fit.column(F.lit(1.0), -2.0)
    for bad in (("sigmoid01", "log10", (1.0,)), ("nothing", "log10", ()), ("sigmoid01", "cube", (0.0, 1.0))):
        with pytest.raises(ValueError):
            curves.CurveFit(*bad)


def test_ra_wraps(spark):
    assert one(spark, sky.ra_offset(F.lit(359.999), F.lit(0.001), F.lit(0.0))) == pytest.approx(-7.2)


def test_ellipse_box(spark):
    dx, dy = sky.ellipse_halfwidths(F.lit(10.0), F.lit(4.0), F.lit(0.0))
    assert (one(spark, dx), one(spark, dy)) == (pytest.approx(2.0), pytest.approx(5.0))


def test_snr_without_noise(spark):
    assert one(spark, sky.snr(F.lit(10.0), F.lit(2.0))) == 5.0
    assert one(spark, sky.snr(F.lit(10.0), F.lit(0.0))) == -1.0


@pytest.mark.parametrize(("component", "flood", "flux", "want"), [(40.0, 55.0, 1.0, (55.0, "flood")), (20.0, 55.0, 1.0, (20.0, "component")), (700.0, 55.0, 1.0, (700.0, "component")), (40.0, 55.0, 0.5, (40.0, "component"))])
def test_chosen_size(spark, component, flood, flux, want):
    s = one(spark, sky.chosen_size(F.lit(component), F.lit(flood), F.lit(flux), F.lit(1.0), F.lit(False), F.lit(False)))
    assert tuple(s) == want


def test_luminosity_and_back(spark):
    d, k = F.lit(1e25), F.lit(1.3)
    assert one(spark, sky.flux_of(sky.luminosity(F.lit(0.01), d, k), d, k)) == pytest.approx(0.01)


def test_images(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, nan, 3.0, -2.0],), ([nan] * 4,)], "image array<double>")
    rows = df.select(images.n_missing(F.col("image")).alias("n"), images.peak(F.col("image")).alias("p"), images.mean(F.col("image")).alias("m")).collect()
    assert tuple(rows[0]) == (1, 3.0, pytest.approx(2 / 3)) and tuple(rows[1]) == (4, None, None)


def test_four_turns_are_none(spark):
    df = spark.createDataFrame([([float(i) for i in range(9)],)], "image array<double>")
    c = F.col("image")
    for _ in range(4):
        df = df.withColumn("image", images.turned(c, 3, F.lit(1), F.lit(False)))
    assert df.first().image == [float(i) for i in range(9)]


def test_band_flux_falls_by_ten_in_two_and_a_half_magnitudes(spark):
    r = one(spark, sky.mag_to_flux(F.lit(10.0), 3) / sky.mag_to_flux(F.lit(12.5), 3))
    assert r == pytest.approx(10.0) and math.isfinite(r)
