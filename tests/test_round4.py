"""Claims of the fourth round's review: zeros with a sign, the sky beyond a pole."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from skycensus.operators import skyjoin
from tests.test_dense_sky import brute, sky


def test_block_means_keep_the_sign_of_zero_and_skip_missing_pixels(spark, tmp_path):
    tiny = [-4e-6] * 64
    rows = [tiny, [-x for x in tiny], [None] * 64, [None] * 32 + [0.5] * 32, [1.0, None, -3.0] * 21 + [2.0], [0.25] * 40, None, [-0.0] * 64]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for other in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {other} AS SELECT * FROM '/root/testdata/sf0.001/{other}.parquet'")
    want = {r[0]: r[1] for r in con.execute(__spark_entry__.oracle_sql()["i15_block_means"]).fetchall()}
    got = {r.idx: r.means for r in __spark_entry__.queries()["i15_block_means"](spark, str(tmp_path)).collect()}
    # repr tells -0.0 from 0.0
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    assert repr(got[0][0]) == "-0.0"


@pytest.mark.parametrize(("dec0", "ra0", "spread"), [(90.0, 0.0, 20.0), (180.0, 359.99, 0.1), (270.03, 0.0, 25.0), (-89.98, 123.0, 180.0), (400.0, 20.0, 0.1)])
def test_sky_beyond_the_poles(spark, dec0, ra0, spread):
    r = np.random.default_rng(int(dec0) + 1000)
    place = lambda n: np.column_stack([(ra0 + r.uniform(-spread, spread, n)) % 360, dec0 + r.uniform(-0.12, 0.12, n)])
    s, where = place(250), place(400)
    size = r.choice([0.5, 6.0, 30.0, 90.0, 700.0], len(where), p=[0.3, 0.4, 0.2, 0.08, 0.02])
    c = np.column_stack([where, size, size * r.uniform(0.3, 1, len(where)), r.uniform(0, 180, len(where))])
    sources, comps = sky(spark, s, c)
    want = brute(s, c)
    assert want
    for most in (20, 10**9):
        got = sorted((x.source_id, int(x.parent)) for x in skyjoin.neighbours(sources, comps, most=most).select("source_id", "parent").collect())
        assert got == want


def test_sky_far_from_a_pole_has_no_crowded_cells(spark, monkeypatch):
    # 1,000 sources a row at 160 degrees, where the cosine is negative: spread over cells, so none is cut
    s = np.column_stack([np.arange(1000) * 0.04, np.full(1000, 160.01)])
    c = np.column_stack([s, np.full((1000, 2), 6.0), np.zeros(1000)])
    sources, comps = sky(spark, s, c)
    monkeypatch.setattr(skyjoin, "_quarters", lambda *a: pytest.fail("a cell was cut"))
    assert skyjoin.neighbours(sources, comps, most=100).count() == len(brute(s, c))


@pytest.fixture(scope="module")
def at_the_pole(tmp_path_factory):
    """The smallest tables with keys that give declinations of 89.96 and 90 degrees, and a connection to them."""
    d = tmp_path_factory.mktemp("pole")
    con = duckdb.connect()
    for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"COPY (SELECT * REPLACE ({k} + 1249000 AS {k}) FROM '/root/testdata/sf0.001/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con, str(d)


@pytest.mark.parametrize("name", ["j05_optical_missplit", "j06_quality_table", "s30_flagged_sample"])
def test_flags_at_the_pole_as_in_sql(spark, at_the_pole, name):
    con, d = at_the_pole
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, d).select(*columns).collect()) == sorted(want.fetchall())


def test_missplit_flags_join_no_own_components(spark, monkeypatch):
    monkeypatch.setattr(skyjoin, "cropped_flags", lambda *a, **k: pytest.fail("own components are not asked for"))
    assert "optical_missplit" in __spark_entry__.queries()["j05_optical_missplit"](spark, "/root/testdata/sf0.001").columns
