"""Transforms, FITS blocks, ranks, the joint fit, cached tables and component sizes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skycensus.functions import transforms
from skycensus.operators import dist, fitting, sizing
from skycensus.sources import files, fits, fits_blocks


def test_transforms_go_there_and_back(spark, tmp_path):
    for t in (transforms.Linear(2.5), transforms.Asinh(0.5, 0.1)):
        v = F.col("v").cast("double")
        assert spark.range(-3, 4).withColumnRenamed("id", "v").select(F.max(F.abs(t.inverse(t.forward(v)) - v)).alias("e")).first().e < 1e-9
        path = str(tmp_path / t.name)
        transforms.save_transform(spark, t, path)
        assert transforms.load_transform(spark, path) == t == transforms.load_transform(spark, t)
    assert transforms.load_transform(spark, {"name": "linear", "k": 2}) == transforms.Linear(2)


@pytest.mark.parametrize("bad", [{"name": "cubic", "k": 1}, {"name": "linear"}, {"name": "asinh", "k": 1, "beta": 2, "more": 3}, {}])
def test_odd_parameters_are_errors(bad):
    with pytest.raises(ValueError):
        transforms.transform_of(bad)


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        transforms.register(transforms.Linear)


def test_fits_table_is_read_in_blocks(spark, tmp_path):
    path = tmp_path / "t.fits"
    n = 1003
    path.write_bytes(fits.table_bytes({"key": ("K", np.arange(n)), "x": ("E", np.linspace(0, 1, n, dtype=np.float32)), "ok": ("L", np.arange(n) % 3 == 0), "name": ("5A", np.array([f"n{i % 7}" for i in range(n)], "S5"))}))
    fits_blocks.register(spark)
    df = spark.read.format("fits_table").option("path", f"file://{path}").option("block_rows", 100).load()
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "float", "boolean", "string"] and df.rdd.getNumPartitions() == 11
    assert df.agg(F.sum("key"), F.count_if("ok"), F.countDistinct("name")).first()[:] == (n * (n - 1) // 2, 335, 7)
    few = spark.read.format("fits_table").schema("name string, key long").option("path", f"file://{path}").load()
    assert few.where("key = 12").collect() == [("n5", 12)]


@pytest.mark.parametrize(("form", "kind"), [("D", "double"), ("1J", "int"), ("20A", "string"), ("L", "boolean")])
def test_column_formats(form, kind):
    assert fits.column_type(form)[1].simpleString() == kind


@pytest.mark.parametrize("form", ["", "3D", "Q", "PE(4)"])
def test_unknown_column_formats_are_errors(form):
    with pytest.raises(ValueError):
        fits.column_type(form)


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), i) for i, x in enumerate(rng.integers(0, 40, 500))]
    got = {r.i: r.place for r in dist.ranked(spark.createDataFrame(rows, "v double, i int"), ["v", "i"], "place", 7).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted(rows), 1)}


def test_joint_fit_recovers_evolution():
    log_l, z = (x.ravel() for x in np.meshgrid(np.linspace(22, 27, 12), [0.1, 0.4, 0.8, 1.5]))
    want = [0.6, 1.8, -5.0, 25.0, 1.2, 0.7]
    y = fitting.evolving_log_density(np.column_stack([log_l, z]), *want)
    got = fitting.joint_fit(pd.DataFrame({"log_l": log_l, "z": z, "y": y, "err": 0.05}))
    assert got.n[0] == 48 and got.popt[0] == pytest.approx(want, abs=0.05) and len(got.perr[0]) == 6
    assert fitting.joint_fit(pd.DataFrame({"log_l": [], "z": [], "y": [], "err": []}))["popt"][0] is None


def test_a_cached_table_is_written_once(spark, tmp_path):
    path = str(tmp_path / "cached")
    assert files.cached(spark.range(3), path).count() == 3 and files.cached(spark.range(9), path).count() == 3


def test_component_sizes_match_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(f"S{i // 3}", float(rng.normal(180, 0.002)), float(rng.normal(30, 0.002)), *map(float, sorted(rng.uniform(1, 9, 2), reverse=True)), float(rng.uniform(0, 180))) for i in range(30)]
    got = {r.parent: r["size"] for r in sizing.component_sizes(spark.createDataFrame(rows, "parent string, ra double, dec double, maj double, min double, pa double")).collect()}
    for k in range(10):
        m = np.array([r[1:] for r in rows if r[0] == f"S{k}"])
        x, y = (m[:, 0] - m[:, 0].mean()) * math.cos(math.radians(m[:, 1].mean())) * 3600, (m[:, 1] - m[:, 1].mean()) * 3600
        p = sizing.outline(x, y, m[:, 2], m[:, 3], m[:, 4])
        assert got[f"S{k}"] == pytest.approx(math.sqrt(((p[:, None] - p[None]) ** 2).sum(-1).max()), rel=1e-6)
