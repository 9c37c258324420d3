"""The sky join where many components and sources lie in one cell."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycensus.operators import skyjoin


def offsets(s, c):
    x = ((c[:, 0][None] - s[:, 0][:, None] + 180) % 360 - 180) * np.cos(np.radians(s[:, 1]))[:, None] * 3600
    return x, (c[:, 1][None] - s[:, 1][:, None]) * 3600


def brute(s, c, half=60.0):
    pa = np.radians(c[:, 4])
    dx = np.hypot(c[:, 2] / 2 * np.sin(pa), c[:, 3] / 2 * np.cos(pa))
    dy = np.hypot(c[:, 2] / 2 * np.cos(pa), c[:, 3] / 2 * np.sin(pa))
    x, y = offsets(s, c)
    i, j = np.nonzero((np.abs(x) <= half + dx[None]) & (np.abs(y) <= half + dy[None]))
    return sorted(zip(i.tolist(), j.tolist(), strict=True))


def sky(spark, s, c):
    sources = spark.createDataFrame([(i, f"S{i}", float(a), float(b), 0.1) for i, (a, b) in enumerate(s)], "source_id int, source_name string, ra double, dec double, isl_rms double").repartition(4)
    comps = spark.createDataFrame([(str(j), float(a), float(b), 1.0, float(m), float(n), float(p)) for j, (a, b, m, n, p) in enumerate(c)], "parent string, ra double, dec double, peak double, maj double, min double, pa double").repartition(4)
    return sources, comps


@pytest.mark.parametrize(("ra0", "dec0", "most"), [(359.99, 41.03, 40), (10.01, -0.02, 25), (200.0, 88.7, 60)])
def test_dense_cells_give_all_pairs(spark, ra0, dec0, most):
    r = np.random.default_rng(int(dec0 * 10) + 900)
    stretch = 1 / np.cos(np.radians(dec0))

    def near(n, spread):
        return np.column_stack([(ra0 + r.uniform(-spread, spread, n) * stretch) % 360, dec0 + r.uniform(-spread, spread, n)])

    s = np.concatenate([near(150, 0.02), near(60, 0.3), np.repeat(near(1, 0.01), 30, axis=0)])
    where = np.concatenate([near(500, 0.02), near(150, 0.3), np.repeat(near(1, 0.005), 90, axis=0)])
    size = r.choice([0.5, 6.0, 30.0, 90.0, 200.0, 700.0], len(where), p=[0.3, 0.4, 0.15, 0.1, 0.04, 0.01])
    c = np.column_stack([where, size, size * r.uniform(0.3, 1, len(where)), r.uniform(0, 180, len(where))])
    sources, comps = sky(spark, s, c)
    want = brute(s, c)
    for m in (most, 10**9):
        got = sorted((x.source_id, int(x.parent)) for x in skyjoin.neighbours(sources, comps, most=m).select("source_id", "parent").collect())
        assert got == want


def test_twenty_thousand_components_of_one_cell_lie_in_no_single_task(spark, monkeypatch):
    r = np.random.default_rng(4)
    c = np.column_stack([10.02 + r.uniform(-0.02, 0.02, 20_000), 0.025 + r.uniform(-0.02, 0.02, 20_000), np.full((20_000, 2), 0.2), np.zeros(20_000)])
    s = np.column_stack([10.02 + r.uniform(-0.02, 0.02, 300), 0.025 + r.uniform(-0.02, 0.02, 300)])
    sources, comps = sky(spark, s, c)
    keys = {}
    real = skyjoin._quarters

    def watched(*a):
        crowd, seen = real(*a)
        by = ["band", "lane", "level", "qx", "qy", "part", "salt"]
        keys["comps"] = crowd.groupBy(*by).count().agg(F.max("count")).first()[0]
        keys["sources"] = seen.groupBy(*by).count().agg(F.max("count")).first()[0]
        return crowd, seen

    monkeypatch.setattr(skyjoin, "_quarters", watched)
    got = skyjoin.neighbours(sources, comps, most=1000)
    assert got.count() == len(brute(s, c))
    assert keys["comps"] <= 1200 and keys["sources"] <= 1200
