"""The committed sink, streamed trials, fitted powers, failing snapshots, and integrals with an error."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycensus.functions.curves import CurveFit
from skycensus.operators import cosmology, dist, evaluate, rlf
from skycensus.operators.binning import log_edges
from skycensus.sources import fits_blocks
from skycensus.streaming.progress import completeness_so_far, each_once

KINDS = "k long, i int, s short, x double, y float, ok boolean, name string, image array<float>"


def catalogue(spark, n=50, first=0):
    rows = [(i, i, i % 7, None if i % 5 == 0 else i / 3, float(i), i % 2 == 0, None if i == 3 else "n" * (i % 4), [float(i), 1.0, float("nan")]) for i in range(first, first + n)]
    return spark.createDataFrame(rows, KINDS).repartition(3)


def test_written_tables_are_read_back_with_all_types(spark, tmp_path):
    fits_blocks.register(spark)
    path = str(tmp_path / "table")
    catalogue(spark).write.format("fits_table").mode("append").option("block_rows", 7).save(path)
    files = fits_blocks.table_files(path)
    assert len(files) >= 8 and all(fits_blocks.table_layout(f)[2] <= 7 for f in files)
    back = spark.read.format("fits_table").option("block_rows", 3).load(path)
    assert dict(back.dtypes) == dict(catalogue(spark).dtypes)
    got = {r.k: r for r in back.collect()}
    for r in catalogue(spark).collect():
        g = got[r.k]
        assert (g.i, g.s, g.y, g.ok, g.name, g.image[:2]) == (r.i, r.s, r.y, r.ok, r.name or "", r.image[:2])
        assert np.isnan(g.x) if r.x is None else g.x == r.x
    catalogue(spark, 5, 100).write.format("fits_table").mode("append").save(path)
    assert spark.read.format("fits_table").load(path).count() == 55
    catalogue(spark, 4, 200).write.format("fits_table").mode("overwrite").save(path)
    assert sorted(r.k for r in spark.read.format("fits_table").load(path).select("k").collect()) == [200, 201, 202, 203]
    left = [f for f in os.listdir(path) if not f.startswith(".")]
    assert sum(f.startswith("_manifest") for f in left) == 1 and sum(f.endswith(".fits") for f in left) == len(fits_blocks.table_files(path))
    empty = str(tmp_path / "empty")
    catalogue(spark).where("k < 0").write.format("fits_table").mode("append").save(empty)
    assert spark.read.format("fits_table").load(empty).count() == 0


def test_a_write_that_fails_leaves_nothing_visible(spark, tmp_path):
    fits_blocks.register(spark)
    path = str(tmp_path / "table")
    catalogue(spark, 20).write.format("fits_table").mode("append").save(path)
    bad = catalogue(spark, 30, 500).withColumn("k", F.when(F.col("k") == 515, F.raise_error(F.lit("a task fails"))).otherwise(F.col("k")).cast("long"))
    for broken in (bad, catalogue(spark, 30, 500).withColumn("i", F.when(F.col("k") != 515, F.col("i"))), catalogue(spark, 30, 500).withColumn("name", F.lit("é"))):
        for mode in ("append", "overwrite"):
            with pytest.raises(Exception):
                broken.write.format("fits_table").mode(mode).option("block_rows", 2).save(path)
    assert spark.read.format("fits_table").load(path).count() == 20
    assert len(fits_blocks.manifests(path)) == 1
    # a file that a lost task has left is not listed, so it is not read
    with open(f"{path}/part-lost.fits", "wb") as f:
        f.write(b"half a file")
    assert spark.read.format("fits_table").load(path).count() == 20
    listed = json.loads(open(f"{path}/{next(iter(fits_blocks.manifests(path)))}").read())
    assert sum(n for _, n in listed["files"]) == 20


def test_replayed_trials_count_once(spark, tmp_path):
    incoming, log = str(tmp_path / "in"), str(tmp_path / "log")
    edges = log_edges(0.1, 10.0, 5)
    trials = spark.range(200).select(F.col("id").alias("trial"), (0.1 + F.col("id") / 25).alias("mock_flux"), (F.col("id") % 3 == 0).alias("detectable"))
    want = {r.bin: (r.n, r.n_detected) for r in completeness_so_far(trials, edges).collect()}
    for part in (trials.where("trial % 2 = 0"), trials.where("trial % 2 = 0"), trials):  # a delivery, the same again, everything
        part.write.mode("append").parquet(incoming)
        rows = spark.readStream.schema(trials.schema).parquet(incoming)
        completeness_so_far(rows, edges, trial="trial").writeStream.outputMode("complete").format("memory").queryName("replayed").option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    assert {r.bin: (r.n, r.n_detected) for r in spark.table("replayed").collect()} == want


def test_trials_within_a_watermark_count_once(spark, tmp_path):
    incoming = str(tmp_path / "in")
    trials = spark.range(50).select((F.col("id") % 20).alias("trial"), (F.timestamp_seconds(F.col("id"))).alias("at"))
    trials.write.parquet(incoming)
    rows = spark.readStream.schema(trials.schema).parquet(incoming)
    each_once(rows, "trial", "at", "1 hour").writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 20


def loglik(x, lam, kind):
    if kind == "box-cox":
        t = np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * np.log(x).sum()
    up, down = x >= 0, x < 0
    t = np.empty_like(x)
    t[up] = np.log1p(x[up]) if abs(lam) < 1e-12 else ((1 + x[up]) ** lam - 1) / lam
    t[down] = -np.log1p(-x[down]) if abs(lam - 2) < 1e-12 else -((1 - x[down]) ** (2 - lam) - 1) / (2 - lam)
    return -len(x) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


@pytest.mark.parametrize("name", ["lognormal", "zeros", "negative", "skewed"])
def test_fitted_powers_match_a_dense_grid(spark, name):
    r = np.random.default_rng(5)
    x = {"lognormal": r.lognormal(size=800), "zeros": np.concatenate([r.exponential(size=700), np.zeros(50)]), "negative": r.standard_normal(800) ** 3, "skewed": r.normal(20, 2, 800) ** 2}[name]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    fit = dist.fit_power(df, "x")
    assert fit.kind == ("box-cox" if x.min() > 0 else "yeo-johnson")
    grid = np.linspace(fit.lam - 0.05, fit.lam + 0.05, 2001)
    coarse = np.linspace(-4, 4, 161)
    assert abs(grid[np.argmax([loglik(x, g, fit.kind) for g in grid])] - fit.lam) < 1e-4
    assert loglik(x, fit.lam, fit.kind) >= max(loglik(x, g, fit.kind) for g in coarse) - 1e-9
    got = df.where("NOT isnan(x)").select(fit.column(F.col("x")).alias("t")).agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("s")).first()
    assert abs(got.m) < 1e-9 and abs(got.s - 1) < 1e-9
    assert dist.fit_power(df.where("x > 1e9"), "x") is None


def test_a_failing_snapshot_keeps_its_row(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None), ("c", 5.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "snapshot string, x double")
    got = evaluate.report_per_group(df, "snapshot", F.when(F.col("x").isNull(), F.lit("unreadable")), {"mean": F.col("x")}, {"median": F.col("x")}).collect()
    by = {r.snapshot: r for r in got}
    assert (by["a"].n, by["a"].error, by["a"]["mean"], by["a"]["median"]) == (2, None, 2.0, 2.0)
    assert by["b"].error == "unreadable" and np.isnan(by["b"]["mean"]) and np.isnan(by["b"]["median"]) and by["b"].n == 2
    assert by["c"]["median"] == 5.0 and by[None]["mean"] == 7.0


def test_refined_integrals_agree_with_a_dense_sum(spark):
    grid, fit = cosmology.grid(), CurveFit("sigmoid", "log10", (0.2, 6.0, 0.95, 0.02))
    cells = rlf.cells(spark, [0.0, 0.3, 0.9], [22.5, 23.5, 24.5], grid)
    table = {(r.iz, r.il): r for r in cells.collect()}
    got = rlf.refined_integrals(cells, grid, fit).collect()
    assert len(got) == 4
    n = 5000
    for r in got:
        c = table[r.iz, r.il]
        edges = np.linspace(c.z_lo, c.z_hi, n + 1)
        z, volume = (edges[1:] + edges[:-1]) / 2, np.diff(np.interp(edges, grid.z, grid.volume))
        lum = 10 ** (c.l_lo + (np.arange(n) + 0.5) / n * (c.l_hi - c.l_lo))
        far = ((1 + z) ** 1.7) / (4 * np.pi * 1e-26 * np.interp(z, grid.z, grid.distance) ** 2)
        want = 0.0
        for i in range(0, n, 500):
            flux = lum[None] * far[i : i + 500, None]
            seen = np.where(flux > rlf.FLUX_CUT_JY, fit.values(np.maximum(flux, 1e-30) * 1000), 0.0)
            want += (seen.mean(axis=1) * volume[i : i + 500]).sum() * (c.l_hi - c.l_lo)
        assert abs(r.i_resolved - want) <= max(1e-4, r.error) * want + 1e-9 * volume.sum() and r.error < 5e-3
    assert len({r.n_points for r in got}) > 1
