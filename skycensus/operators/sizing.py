"""Sizes of sources from their components: the brightest share, ellipse outlines, the furthest pair of outline points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

POINTS, BUFFER_ARCSEC, SHARE = 200, 0.1, 0.95
#: Partial hulls of a source that are merged at once, and components of a source beyond which they are dealt to several tasks.
FAN, SPREAD = 64, 10_000
#: Components of a source up to which its size is worked out in its own row, without hulls; pairs, and pairs of outline points, that are looked at together.
FEW, PAIRS, CROSSES = 64, 100_000, 1_000_000


def brightest_share(components: DataFrame, key: str = "parent", flux: str = "peak", tie: list[str] | None = None, share: float = SHARE, dark: str = "error") -> DataFrame:
    """Components in falling flux until their running sum reaches ``share`` of the source's; the one that reaches it stays.

    A source whose fluxes have no positive sum is an error when it is read, or dropped if ``dark`` says so.
    """
    if dark not in ("error", "drop"):
        raise ValueError("dark sources are an error or are dropped")
    order = [F.desc(flux), *(F.col(c) for c in tie or [])]
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(key)
    out = components.withColumns({"_before": F.coalesce(F.sum(flux).over(running), F.lit(0.0)), "_all": F.sum(flux).over(every)})
    lit = F.coalesce(F.col("_all") > 0, F.lit(False))
    if dark == "error":
        lit = F.when(lit, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("the components have no flux: "), F.col(key).cast("string"))).cast("boolean"))
    return out.where(lit & (F.try_divide("_before", "_all") < share)).drop("_before", "_all")


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, anticlockwise; all different points if they lie on a line."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append([x, y])
        return out

    rows = p.tolist()  # Python's numbers: the chain looks at one point at a time
    ring = chain(rows)[:-1] + chain(rows[::-1])[:-1]
    return np.array(ring) if len(ring) > 2 else p


def outer(points: np.ndarray) -> np.ndarray:
    """The points but for those that lie well inside the ring of the 16 furthest ones in as many directions: none of these is on the hull."""
    if len(points) <= 64:
        return points
    turn = np.arange(16) * (math.pi / 8)
    reach = points @ np.array([np.cos(turn), np.sin(turn)])
    corner = points[reach.argmax(axis=0)]
    after = np.roll(corner, -1, axis=0)
    side = after - corner
    inside = side[:, 0, None] * (points[:, 1] - corner[:, 1, None]) - side[:, 1, None] * (points[:, 0] - corner[:, 0, None])
    wide = np.hypot(side[:, 0], side[:, 1])[:, None]
    return points[~((inside > 1e-9 * wide) | (wide == 0)).all(axis=0)]


def furthest(points: np.ndarray) -> float:
    """Largest squared distance of two points."""
    h = hull(outer(points))
    d = h[:, None, :] - h[None, :, :]
    return float((d * d).sum(-1).max()) if len(h) > 1 else 0.0


def outline(x: np.ndarray, y: np.ndarray, major: np.ndarray, minor: np.ndarray, pa: np.ndarray, n: int = POINTS, buffer: float = BUFFER_ARCSEC) -> np.ndarray:
    """Boundary points (arcsec) of ellipses with full axes in arcsec, a buffer added to the half-axes."""
    t = 2 * math.pi * np.arange(n) / n
    a, b, turn = major / 2 + buffer, minor / 2 + buffer, np.radians(pa)
    u, v = a[:, None] * np.cos(t), b[:, None] * np.sin(t)
    px = x[:, None] + u * np.sin(turn)[:, None] + v * np.cos(turn)[:, None]
    py = y[:, None] + u * np.cos(turn)[:, None] - v * np.sin(turn)[:, None]
    return np.column_stack([px.ravel(), py.ravel()])


def centres(components: DataFrame, key: str) -> DataFrame:
    """(key, n, ra0, dec0): number and mean position of each source's components; right ascensions on both sides of zero are taken as near."""
    turned = F.pmod(F.col("ra") + 180, F.lit(360.0)) - 180
    got = components.groupBy(key).agg(F.count("*").alias("n"), F.max("ra").alias("hi"), F.min("ra").alias("lo"), F.avg("ra").alias("plain"), F.avg(turned).alias("turned"), F.avg("dec").alias("dec0"))
    return got.select(key, "n", F.when(F.col("hi") - F.col("lo") > 180, F.col("turned")).otherwise(F.col("plain")).alias("ra0"), "dec0")


def partial_hulls(components: DataFrame, key: str, n_points: int = POINTS) -> DataFrame:
    """(key, n, major, x, y): hulls (arcsec from the source's centre) of the outlines of some of each source's components, one or more a source.

    A task sees a batch of components at a time and holds a hull for each source of the batch, so a source of any number of components
    takes no more room than its hull.
    """
    # a source's components go to one place, those of a very large one to several; hulls cost far more than their bytes say, so the number of partitions is set
    n = int(components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = components.join(centres(components, key).withColumnRenamed("n", "_all"), key)
    placed = joined.repartition(n, key, F.floor(F.rand(5) * F.ceil(F.col("_all") / SPREAD))).sortWithinPartitions(key).select(key, "ra", "dec", "maj", "min", "pa", "ra0", "dec0", "_all")
    kind = components.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            codes = b.column(0).dictionary_encode()
            ra, dec, major, minor, angle, ra0, dec0, n_all = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 9))
            x = ((ra - ra0 + 180) % 360 - 180) * np.cos(np.radians(dec0)) * 3600
            y = (dec - dec0) * 3600
            of = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
            hulls = []
            for rows in runs:
                if n_all[rows[0]] == 1:  # a single component's own axis is its size
                    hulls.append(np.zeros((0, 2)))
                    continue
                ring = np.zeros((0, 2))
                for i in range(0, len(rows), 256):
                    some = rows[i : i + 256]
                    ring = hull(outer(np.concatenate([ring, outline(x[some], y[some], major[some], minor[some], angle[some], n_points)])))
                hulls.append(ring)
            lead = np.array([r[0] for r in runs])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hulls])]).astype(np.int32))
            points = np.concatenate(hulls)
            columns = [b.column(0).take(pa.array(lead)), pa.array([len(r) for r in runs], pa.int64()), pa.array(major[lead]), pa.ListArray.from_arrays(ends, pa.array(points[:, 0])), pa.ListArray.from_arrays(ends, pa.array(points[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n", "major", "x", "y"])

    return placed.mapInArrow(run, f"{key} {kind}, n long, major double, x array<double>, y array<double>")


def merged_hulls(hulls: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """One hull for each source from its partial ones: rounds that merge ``fan`` of them at most, so that no task has all of a source's."""
    kind = hulls.schema[key].dataType.simpleString()
    by = f"{key} {kind}, n long, major double, x array<double>, y array<double>"

    def merge(group: pa.Table) -> pa.Table:
        points = np.column_stack([group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in "xy"])
        h = hull(outer(points)) if len(points) else points
        return pa.table({key: group[key].slice(0, 1), "n": [sum(group["n"].to_pylist())], "major": group["major"].slice(0, 1), "x": pa.array([h[:, 0]], pa.list_(pa.float64())), "y": pa.array([h[:, 1]], pa.list_(pa.float64()))})

    now = stored(hulls, "hulls")
    while (most := now.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > 1:
        several = stored(now.groupBy(key).count().where("count > 1").select(key), "several")
        dealt = now.join(several, key).withColumn("_deal", F.floor(F.rand(11) * -(-most // fan)))
        now = stored(now.join(several, key, "left_anti").unionByName(dealt.groupBy(key, "_deal").applyInArrow(merge, by)), "hulls")
    return now


def _runs(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose weights sum up to ``most`` or so, or that hold one."""
    ends = np.cumsum(weights)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield slice(first, last)
        first = last


def _within(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the numbers ``first`` to ``first + n - 1`` of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]


def few_sizes(x: np.ndarray, y: np.ndarray, major: np.ndarray, minor: np.ndarray, pa: np.ndarray, n: np.ndarray, points: int = POINTS, buffer: float = BUFFER_ARCSEC) -> np.ndarray:
    """Size of each source from its ``n`` components, which follow one another: the furthest pair of their outlines' points.

    For two ellipses the support along the line of their centres bounds the distance from above and names two points that bound it from
    below.  Only pairs of ellipses that may beat the source's best such points are looked at, and only at points that may: along that
    line a point falls off from the support as the cosine of its angle from it.
    """
    a, b, turn = major / 2 + buffer, minor / 2 + buffer, np.radians(pa)
    sin, cos = np.sin(turn), np.cos(turn)
    step = 2 * math.pi / points
    t = 2 * math.pi * np.arange(points) / points
    ring_u, ring_v = np.cos(t), np.sin(t)

    def point(i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = a[i] * ring_u[k % points], b[i] * ring_v[k % points]
        return x[i] + u * sin[i] + v * cos[i], y[i] + u * cos[i] - v * sin[i]

    ends = np.cumsum(n)
    out = np.where(n == 1, major[ends - n], 0.0)
    for some in _runs(n * (n + 1) // 2, PAIRS):
        own = np.repeat(np.arange(some.start, some.stop), n[some])
        lead = np.arange(ends[some.start] - n[some.start], ends[some.stop - 1])
        row, j = _within(lead, ends[own] - lead)
        i, of = lead[row], own[row]
        many = n[of] > 1
        i, j, of = i[many], j[many], of[many]
        if not len(i):
            continue
        dx, dy = x[j] - x[i], y[j] - y[i]
        d = np.hypot(dx, dy)
        # without a line of centres any does: the first one's own axis
        with np.errstate(invalid="ignore", divide="ignore"):
            ux, uy = np.where(d > 0, dx / d, sin[i]), np.where(d > 0, dy / d, cos[i])

        def support(e: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Reach along a direction, its angle on the ellipse, and the reach across."""
            along, across = vx * sin[e] + vy * cos[e], vx * cos[e] - vy * sin[e]
            return np.hypot(a[e] * along, b[e] * across), np.arctan2(b[e] * across, a[e] * along), np.hypot(a[e] * across, b[e] * along)

        hi, ti, wi = support(i, -ux, -uy)
        hj, tj, wj = support(j, ux, uy)
        px, py = point(i, np.rint(ti / step).astype(np.int64))
        qx, qy = point(j, np.rint(tj / step).astype(np.int64))
        low = (px - qx) ** 2 + (py - qy) ** 2
        best = np.zeros(len(n))
        np.maximum.at(best, of, low)
        wide = (wi + wj) ** 2
        may = np.flatnonzero((d + hi + hj) ** 2 + wide >= best[of] * (1 - 1e-9))
        # what both ellipses must reach along the line
        need = np.sqrt(np.maximum(best[of[may]] * (1 - 1e-9) - wide[may], 0.0)) - d[may]

        def window(h: np.ndarray, other: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """First point and number of points that reach far enough."""
            with np.errstate(invalid="ignore", divide="ignore"):
                angle = np.arccos(np.clip((need - other) / h, -1.0, 1.0)) + 1e-6
            whole = (angle >= math.pi - step) | ~(h > 0)
            first = np.where(whole, 0, np.ceil((at - angle) / step)).astype(np.int64)
            return first, np.where(whole, points, np.floor((at + angle) / step) - first + 1).astype(np.int64)

        (fi, ni), (fj, nj) = window(hi[may], hj[may], ti[may]), window(hj[may], hi[may], tj[may])
        there = (ni > 0) & (nj > 0)
        may, fi, ni, fj, nj = may[there], fi[there], ni[there], fj[there], nj[there]
        for part in _runs(ni * nj, CROSSES):
            at, kj = _within(fj[part], nj[part])
            qx, qy = point(j[may[part]][at], kj)
            at, ki = _within(fi[part], ni[part])
            px, py = point(i[may[part]][at], ki)
            first = (np.cumsum(nj[part]) - nj[part])[at]
            p, q = _within(first, nj[part][at])
            d2 = (px[p] - qx[q]) ** 2 + (py[p] - qy[q]) ** 2
            crosses = ni[part] * nj[part]
            np.maximum.at(best, of[may[part]], np.maximum.reduceat(d2, np.cumsum(crosses) - crosses))
        out[some] = np.where(n[some] > 1, np.sqrt(best[some]), out[some])
    return out


def component_sizes(components: DataFrame, key: str = "parent", n_points: int = POINTS, counted: DataFrame | None = None) -> DataFrame:
    """(key, n, size arcsec): the widest extent of a source's component ellipses on the tangent plane at their mean position.

    The size of a source of one component is its full axis.  A source of up to ``FEW`` components is a row; hulls of larger ones are an
    aggregate: made batch by batch, merged by source.  ``counted``: rows that hold at least the components, if they are cheaper to count.
    """
    many = stored((components if counted is None else counted).groupBy(key).agg(F.count("*").alias("_all")).where(F.col("_all") > FEW).select(key), "many")
    if many.isEmpty():
        return _few(components, key, n_points)
    # a null key is a source too
    same = components[key].eqNullSafe(many[key])
    large = stored(components.join(many, same, "left_semi"), "large")
    return _few(components.join(many, same, "left_anti"), key, n_points).unionByName(_large(large, key, n_points))


def _few(components: DataFrame, key: str, n_points: int) -> DataFrame:
    kind = components.schema[key].dataType.simpleString()
    names = ["ra", "dec", "maj", "min", "pa"]
    rows = components.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in names])).alias("c"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ra, dec, major, minor, angle = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
            first = np.cumsum(n) - n
            mean = lambda v: np.repeat(np.add.reduceat(v, first) / n, n)
            across = np.repeat(np.maximum.reduceat(ra, first) - np.minimum.reduceat(ra, first) > 180, n)
            ra0, dec0 = np.where(across, mean((ra + 180) % 360 - 180), mean(ra)), mean(dec)
            x = ((ra - ra0 + 180) % 360 - 180) * np.cos(np.radians(dec0)) * 3600
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(few_sizes(x, (dec - dec0) * 3600, major, minor, angle, n, n_points))], [key, "n", "size"])

    return rows.mapInArrow(sizes, f"{key} {kind}, n int, size double")


def _large(components: DataFrame, key: str, n_points: int) -> DataFrame:
    kind = components.schema[key].dataType.simpleString()

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, major = b.column(1).to_pylist(), b.column(2).to_pylist()
            x, y = b.column(3), b.column(4)
            sizes = [m if k == 1 else math.sqrt(furthest(np.column_stack([x[i].values.to_numpy(), y[i].values.to_numpy()]))) for i, (k, m) in enumerate(zip(n, major, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(sizes, pa.float64())], [key, "n", "size"])

    return merged_hulls(partial_hulls(components, key, n_points), key).mapInArrow(widest, f"{key} {kind}, n int, size double")
