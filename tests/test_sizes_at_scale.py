"""Sizes by merged hulls against all pairs of outline points."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycensus.operators import sizing


def brute(rows, n=200):
    m = np.array(rows, float)
    if len(m) == 1:
        return m[0, 2]
    ra0 = m[0, 0] + np.mean((m[:, 0] - m[0, 0] + 180) % 360 - 180)
    x = ((m[:, 0] - ra0 + 180) % 360 - 180) * np.cos(np.radians(m[:, 1].mean())) * 3600
    p = sizing.outline(x, (m[:, 1] - m[:, 1].mean()) * 3600, m[:, 2], m[:, 3], m[:, 4], n)
    turn = np.arange(720) * np.pi / 720
    reach = p @ np.array([np.cos(turn), np.sin(turn)])
    few = np.unique(np.concatenate([reach.argmax(axis=0), reach.argmin(axis=0)]))
    # the widest pair is close to the widest of 720 directions: all pairs of the points that come near it
    wide = (reach.max(axis=0) - reach.min(axis=0)).max()
    far = p if len(p) < 3000 else p[few]
    d = ((far[:, None] - far[None]) ** 2).sum(-1).max()
    assert np.sqrt(d) >= wide - 1e-6
    return float(np.sqrt(d))


def test_hulls_merge_to_the_sizes_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sizing, "FAN", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = np.random.default_rng(2)
        rows = []
        for k, n in enumerate([1, 2, 3, 5, 8, 13, 21, 2, 1]):
            ra = (r.uniform(-0.02, 0.02, n) + (0.0 if k % 2 else 120.0)) % 360
            rows += [(f"P{k}", float(a), float(b), float(m), float(m / 2), float(q)) for a, b, m, q in zip(ra, 50 + r.uniform(-0.02, 0.02, n), r.uniform(1, 30, n), r.uniform(0, 180, n), strict=True)]
        rows += [("P2", *rows[3][1:])]  # a repeated component
        df = spark.createDataFrame(rows, "parent string, ra double, dec double, maj double, min double, pa double").repartition(6)
        merged = sizing.merged_hulls(sizing.partial_hulls(df, "parent"), "parent", 2)
        assert merged.count() == 9 and merged.agg(F.sum("n")).first()[0] == len(rows)
        got = {x.parent: (x.n, x["size"]) for x in sizing.component_sizes(df).collect()}
        for k in got:
            own = [x[1:] for x in rows if x[0] == k]
            assert got[k][0] == len(own) and np.isclose(got[k][1], brute(own), rtol=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizing.component_sizes(df.where("maj < 0")).count() == 0


def test_a_source_of_a_hundred_thousand_components(spark):
    u = lambda k: F.rand(k)
    df = spark.range(0, 100_000, 1, 8).select(F.lit("hot").alias("parent"), (200 + u(1) * 0.05).alias("ra"), (30 + u(2) * 0.05).alias("dec"), (5 + u(3) * 20).alias("maj"), (3 + u(4)).alias("min"), (u(5) * 180).alias("pa"))
    df = df.unionByName(spark.createDataFrame([("small", 10.0, 10.0, 8.0, 4.0, 0.0)], "parent string, ra double, dec double, maj double, min double, pa double"))
    got = {x.parent: x for x in sizing.component_sizes(df).collect()}
    assert got["small"]["size"] == 8.0 and got["hot"].n == 100_000
    rows = [tuple(x)[1:] for x in df.where("parent = 'hot'").collect()]
    m = np.array(rows)
    x = (m[:, 0] - m[:, 0].mean()) * np.cos(np.radians(m[:, 1].mean())) * 3600
    y = (m[:, 1] - m[:, 1].mean()) * 3600
    edge = (np.abs(x) > 70) & (np.abs(y) > 80)
    p = sizing.outline(x[edge], y[edge], m[edge, 2], m[edge, 3], m[edge, 4])
    assert np.isclose(got["hot"]["size"], np.sqrt(sizing.furthest(p)), rtol=1e-9)


def test_sources_without_flux_are_an_error_or_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 0.0), ("c", None)], "parent string, peak double")
    with pytest.raises(Exception, match="no flux"):
        sizing.brightest_share(df).collect()
    assert {x.parent for x in sizing.brightest_share(df, dark="drop").collect()} == {"a"}


def test_sizes_of_small_sources_are_those_of_all_outline_points():
    r = np.random.default_rng(8)
    for spread, most in ((150, 8), (20, 8), (3, 8), (0, 8), (60, 30)):
        n = r.integers(1, most, 120)
        x, y = r.uniform(-spread, spread, (2, n.sum()))
        major = r.uniform(0.01, 30, n.sum())
        minor, pa = major * r.uniform(0, 1, n.sum()), r.uniform(0, 180, n.sum())
        got, ends = sizing.few_sizes(x, y, major, minor, pa, n), np.cumsum(n)
        for k, end in enumerate(ends):
            s = slice(end - n[k], end)
            want = major[s][0] if n[k] == 1 else np.sqrt(sizing.furthest(sizing.outline(x[s], y[s], major[s], minor[s], pa[s])))
            assert np.isclose(got[k], want, rtol=1e-9)


def test_small_sources_take_no_hulls(spark, monkeypatch):
    rows = [(f"P{k}" if k else None, 10.0 + k % 3 * 1e-3, 20.0 + i * 1e-3, 8.0, 4.0, 10.0 * i) for k in range(30) for i in range(k % 7 + 1)]
    rows += [("large", 359.999 + i * 1e-4 - 360 * (i > 9), 5.0, 6.0, 3.0, float(i)) for i in range(sizing.FEW + 1)]
    df = spark.createDataFrame(rows, "parent string, ra double, dec double, maj double, min double, pa double").repartition(3)
    real, seen = sizing.partial_hulls, []
    monkeypatch.setattr(sizing, "partial_hulls", lambda c, *a: real(seen.append(c.select("parent").distinct().collect()) or c, *a))
    got = {x.parent: (x.n, x["size"]) for x in sizing.component_sizes(df).collect()}
    assert [[x.parent for x in s] for s in seen] == [["large"]]
    assert set(got) == {x[0] for x in rows}
    for k, (n, size) in got.items():
        own = [x[1:] for x in rows if x[0] == k]
        assert n == len(own) and np.isclose(size, brute(own), rtol=1e-9)
