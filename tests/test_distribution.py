"""Distributions by name, and one that a user adds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycensus.operators import distribution as D


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(1)
    x = [*map(float, r.lognormal(size=2000)), 0.0, -1.0, float("nan"), None]
    rows = [(v, i % 3 > 0) for i, v in enumerate(x)]
    return {"catalogue": spark.createDataFrame(rows, "isl_rms double, resolved boolean").repartition(3)}


def kept(tables, share):
    x = np.array([r.isl_rms for r in tables["catalogue"].where("resolved").collect() if r.isl_rms is not None and r.isl_rms > 0])
    return x[x < np.quantile(x, share)]


def test_a_preset_cleans_bins_and_describes(tables):
    rms = D.distribution_of("rms", tables)
    want = kept(tables, 0.95)
    got = rms.histogram().orderBy("bin").collect()
    counts, edges = np.histogram(want, bins=100)
    assert [r.n for r in got] == counts.tolist() and np.allclose([r.lo for r in got], edges[:-1])
    s = rms.statistics().first()
    assert s.n == len(want) and np.isclose(s["median"], np.median(want)) and np.isclose(s.p99, np.quantile(want, 0.99)) and np.isclose(s["std"], want.std())
    every = D.distribution_of("rms", tables, share=1.0, bins=7, log=True).histogram()
    assert every.count() == 6 and every.agg(F.sum("n")).first()[0] == len(kept(tables, 1.0))


def test_a_user_s_own_distribution_and_samples(spark, tables):
    @D.registered("doubled")
    class Doubled(D.Distribution):
        share, bins = 0.9, 20

        def raw(self, tables):
            return tables["catalogue"].select(F.col("isl_rms") * 2)

    try:
        own = D.distribution_of("doubled", tables)
        bins = own.histogram().orderBy("bin").collect()
        total = sum(b.n for b in bins)
        u = spark.range(2001).select((F.col("id") / 2000).alias("u"))
        got = own.sampled(u, F.col("u"), "x").orderBy("u").collect()
        assert np.isclose(got[0].x, bins[0].lo) and np.isclose(got[-1].x, max(b.hi for b in bins if b.n)) and all(a.x <= b.x + 1e-12 for a, b in zip(got, got[1:], strict=False))
        for b in bins:
            inside = sum(b.lo <= r.x < b.hi for r in got[:-1]) / 2000
            assert abs(inside - b.n / total) < 2e-3
        with pytest.raises(ValueError):
            D.registered("doubled")(Doubled)
    finally:
        del D.DISTRIBUTIONS["doubled"]


def test_empty_single_and_wrong_distributions(spark, tables):
    nothing = {"catalogue": tables["catalogue"].where("isl_rms < 0")}
    none = D.distribution_of("rms", nothing)
    assert none.histogram().count() == 0 and none.statistics().first().n == 0
    assert none.sampled(spark.range(2), F.lit(0.5), "x").where("x IS NOT NULL").count() == 0
    one = D.distribution_of("rms", {"catalogue": spark.createDataFrame([(1.0, True), (1.0, True), (5.0, True)], "isl_rms double, resolved boolean")})
    assert one.values().count() == 2 and one.histogram().agg(F.sum("n")).first()[0] == 2
    with pytest.raises(ValueError):
        D.distribution_of("no such", tables)
    with pytest.raises(TypeError):
        D.distribution_of("rms", tables, colour=1)

    class Two(D.Distribution):
        def raw(self, tables):
            return tables["catalogue"]

    with pytest.raises(ValueError):
        Two(tables).values()
