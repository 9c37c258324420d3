"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from skycensus import plans

SF = "/root/testdata/sf0.001"
#: A spread over all modules; the driver compares every query.
SOME = ["m04_completeness_curve", "f04_classes", "f08_funnel", "j02_foreign_components", "j03_cropped", "b07_histogram", "b18_wasserstein", "b19_kernel_distance", "b23_calibration_curve", "i10_islands", "i13_full_neighbours", "j10_nearest_neighbour", "b20_density_coverage", "s01_fits_blocks", "s20_stored_transform", "v04_transforms_by_name", "b15_round_trip", "j12_rank_band_match", "m09_volume_integrals", "i09_ellipse_cover", "s29_peak_metadata", "p01_sigmoid", "p02_sigmoid01", "p03_richards", "j14_trials_expansion", "b13_linear_fit", "m12_page_carrera", "x02_log_values", "t02_streamed_completeness", "t02_replayed_completeness", "j10_memorisation", "j12_pixel_match", "b11_presets", "v05_user_distribution", "b21_distribution_report", "m19_failing_snapshots", "s17_committed_set", "s21_binned_text_round_trip", "s10_truncated_files", "b10_statistics", "b12_mad_noise"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), columns)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 14


def test_names_are_callable_and_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
