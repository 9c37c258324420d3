"""Images found again in another set."""

from __future__ import annotations

import numpy as np
import pytest

from skycensus.operators import pixel_match


def brute(queries, base, reach=10):
    sums = {k: np.nansum(v) for k, v in base.items()}
    ranked = sorted(base, key=lambda k: (sums[k], k))
    out = {}
    for q, v in queries.items():
        if not ranked:
            out[q] = (None, False, None)
            continue
        centre = min(range(len(ranked)), key=lambda i: (abs(sums[ranked[i]] - np.nansum(v)), sums[ranked[i]] < np.nansum(v), i if sums[ranked[i]] >= np.nansum(v) else -i))
        near = [k for k in ranked[max(0, centre - reach) : centre + reach + 1] if len(base[k]) == len(v)]
        same = [k for k in near if (np.abs(base[k] - v) <= 1e-6 + 1e-5 * np.abs(v)).all()]
        if same:
            out[q] = (same[0], True, 0.0)
        elif near:
            off = [np.nansum(np.abs(base[k] - v)) for k in near]
            out[q] = (near[int(np.argmin(off))], False, min(off))
        else:
            out[q] = (None, False, None)
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_matches_and_nearest_candidates(spark, block):
    r = np.random.default_rng(3)
    base = {k: r.standard_normal(9) * 0.01 for k in range(200)}
    for k in range(60, 90):
        base[k] = base[60].copy()  # copies: one sum, many ranks
    base[7][2] = np.nan
    base[500] = r.standard_normal(4)
    queries = {k: base[k] + 1e-9 for k in range(0, 100)} | {k: base[k] * 1.1 for k in range(100, 150)}
    queries |= {600 + i: base[60] for i in range(50)} | {700: r.standard_normal(25), 701: np.zeros(9)}
    frame = lambda d: spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in d.items()] + [(9999, None)], "k long, image array<double>").repartition(4)
    got = {x.q: (x.b, x.matched, x.difference) for x in pixel_match.match(frame(queries), frame(base), "k", "image", block=block).collect()}
    want = brute(queries, base)
    assert got.keys() == want.keys()
    for q, (b, same, off) in want.items():
        assert got[q][:2] == (b, same) and (off is None and got[q][2] is None or np.isclose(got[q][2], off)), q
    assert got[7] == (got[7][0], False, got[7][2])  # a missing pixel matches nothing
    none = pixel_match.match(frame(queries), frame({}).where("k < 0"), "k", "image")
    assert {x.b for x in none.collect()} == {None} and pixel_match.match(frame({}).where("k < 0"), frame(base), "k", "image").count() == 0
