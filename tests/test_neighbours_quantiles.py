"""Exact neighbours and quantiles against brute force, and how much they compare."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycensus.operators import metric_space, quantiles


def frame(spark, keys, vectors, *more, schema="key long, vec array<double>", parts=4):
    return spark.createDataFrame([(int(k), None if v is None else [float(x) for x in v], *m) for k, v, *m in zip(keys, vectors, *more, strict=True)], schema).repartition(parts)


def brute(base, queries, k, same):
    d2 = np.array([[((q - b) ** 2).sum() for b in base] for q in queries])
    if same:
        np.fill_diagonal(d2, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(base)), d2.shape), d2))[:, :k]
    return {(i, r + 1): (int(b), float(d2[i, b])) for i, row in enumerate(order) for r, b in enumerate(row) if np.isfinite(d2[i, b])}


def clustered(n, d=6, seed=0):
    r = np.random.default_rng(seed)
    return r.standard_normal((25, d))[r.integers(0, 25, n)] * 20 + r.standard_normal((n, d))


def test_neighbours_of_a_set_within_itself(spark):
    v = clustered(1500)
    v[100:400] = v[7]  # copies
    index = metric_space.build(frame(spark, range(1500), v), "key", "vec", block_rows=32)
    assert index.cells.n.sum() == 1500 and index.cells.n.max() <= 64
    got = metric_space.nearest_k(index, frame(spark, range(1500), v), "key", "vec", 5).collect()
    want = brute(v, v, 5, True)
    have = {(r.q, r.r): (r.b, r.d2) for r in got}
    assert have.keys() == want.keys() and all(np.isclose(have[k][1], want[k][1]) for k in want)
    assert all(have[k][0] == want[k][0] for k in want)
    assert index.compared < 0.25 * 1500 * 1500


def test_neighbours_between_sets_with_rows_that_take_no_part(spark):
    base, asked = clustered(600), clustered(80, seed=1)
    rows = frame(spark, range(603), [*base, None, [float("nan")] * 6, [1.0, float("inf"), 0, 0, 0, 0]])
    index = metric_space.build(rows, "key", "vec", block_rows=50)
    got = metric_space.nearest_k(index, frame(spark, range(81), [*asked, None]), "key", "vec", 3, others=False).collect()
    want = brute(base, asked, 3, False)
    assert {(r.q, r.r): r.b for r in got} == {k: b for k, (b, _) in want.items()}
    few = metric_space.build(frame(spark, [0, 1], base[:2]), "key", "vec")
    assert metric_space.nearest_k(few, frame(spark, [0, 1], base[:2]), "key", "vec", 4).count() == 2
    none = metric_space.build(rows.where("key < 0"), "key", "vec")
    assert metric_space.nearest_k(none, rows, "key", "vec").count() == 0
    assert metric_space.nearest_k(index, rows.where("key < 0"), "key", "vec").count() == 0


def test_a_hot_block_meets_its_queries_in_groups(spark, monkeypatch):
    monkeypatch.setattr(metric_space, "QUERIES", 16)
    v = np.zeros((300, 2))
    v[250:] = np.arange(50)[:, None] + 5.0
    index = metric_space.build(frame(spark, range(300), v), "key", "vec", block_rows=20)
    got = {(r.q, r.r): r.b for r in metric_space.nearest_k(index, frame(spark, range(300), v), "key", "vec", 2).collect()}
    assert got == {k: b for k, (b, _) in brute(v, v, 2, True).items()}


def test_ball_counts(spark):
    base, centres = clustered(900), clustered(60, seed=2)
    radius = np.random.default_rng(5).choice([0.0, 1.0, 3.0, 30.0, 500.0], 60)
    index = metric_space.build(frame(spark, range(900), base), "key", "vec", block_rows=40)
    balls = frame(spark, range(62), [*centres, None, base[0]], [*map(float, radius), 1.0, None], schema="key long, vec array<double>, radius double")
    got = {r.q: r.n for r in metric_space.ball_counts(index, balls, "key", "vec", "radius").collect()}
    assert got == {i: int((np.sqrt(((base - c) ** 2).sum(axis=1)) <= r).sum()) for i, (c, r) in enumerate(zip(centres, radius, strict=True))}
    assert index.compared < 0.5 * 900 * 60
    none = metric_space.build(balls.where("key < 0"), "key", "vec")
    assert {r.n for r in metric_space.ball_counts(none, balls, "key", "vec", "radius").collect()} == {0}


SHARES = [0.0, 0.025, 0.5, 0.9, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("leaf", [10_000, 20])
def test_quantiles_of_hard_columns(spark, leaf):
    r = np.random.default_rng(1)
    columns = {
        "smooth": r.standard_normal(4000),
        "heavy tails": np.exp(r.standard_normal(4000) * 60),
        "one hot value": np.where(r.random(4000) < 0.4, 1.5, r.standard_normal(4000)),
        "few values": r.integers(0, 3, 4000).astype(float),
        "constant": np.full(500, -2.0),
        "single": np.array([7.0]),
    }
    for name, x in columns.items():
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
        n, got = quantiles.quantiles(df, "x", SHARES, leaf=leaf)[()]
        assert n == len(x), name
        assert np.allclose(got, np.quantile(x, SHARES), rtol=1e-12, atol=0), name


def test_quantiles_by_group_skip_what_is_no_number(spark):
    r = np.random.default_rng(2)
    rows = [(None if g == 3 else f"g{g}", float(x)) for g, x in zip(r.integers(0, 4, 3000), r.exponential(size=3000), strict=True)]
    rows += [("g0", None), ("g1", float("nan")), ("g2", float("inf")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = quantiles.quantiles(df, "x", SHARES, ["g"], leaf=50)
    for g in ("g0", "g1", "g2", None):
        x = [v for k, v in rows if k == g and v is not None and np.isfinite(v)]
        assert got[(g,)][0] == len(x) and np.allclose(got[(g,)][1], np.quantile(x, SHARES), rtol=1e-12)
    assert ("empty",) not in got
    table = quantiles.quantile_table(df, "x", {"m": 0.5}, ["g"])
    assert table.columns == ["g", "m"] and table.count() == 4
    assert quantiles.quantile_table(df.where("x < 0"), "x", {"m": 0.5}).collect() == [(None,)]
    assert quantiles.median(df.where("x < 0"), "x") is None


def test_mad(spark):
    x = np.random.default_rng(3).standard_cauchy(3001)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    assert np.isclose(quantiles.mad(df, "x"), np.median(np.abs(x - np.median(x))), rtol=1e-12)


def test_visits_are_handed_on_in_small_batches_of_keys(spark, monkeypatch):
    r = np.random.default_rng(14)
    v = r.normal(size=(400, 12))
    rows = frame(spark, range(400), v).coalesce(1)
    real, tables = metric_space.stored, []

    def watched(df, tag, *a, **k):
        out = real(df, tag, *a, **k)
        tables.append((tag, df.columns))
        return out

    monkeypatch.setattr(metric_space, "stored", watched)
    monkeypatch.setattr(metric_space, "VISITS", 7)
    index = metric_space.build(rows, "key", "vec", block_rows=10)
    got = {x.q: x.b for x in metric_space.nearest_k(index, rows, "key", "vec").collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    balls = rows.withColumn("radius", F.lit(4.0))
    counts = {x.q: x.n for x in metric_space.ball_counts(index, balls, "key", "vec", "radius").collect()}
    assert counts == {i: int((np.sqrt(d[i]) <= 4.0).sum()) for i in range(400)}
    np.fill_diagonal(d, np.inf)
    assert got == {i: int(d[i].argmin()) for i in range(400)}
    visits = [columns for tag, columns in tables if tag == "visits"]
    assert visits and not any("v" in columns for columns in visits)
