"""Whitening of embeddings onto their leading principal components.

Sums and products of the integer coordinates are added up exactly in Spark, task by task; only the matrix, whose size is that of the
dimensions, comes to the driver.  Its leading eigenvectors are found there by FEAST: inertia counts place intervals around the wanted
eigenvalues, a contour integral of shifted solves filters a random block onto each interval, Rayleigh-Ritz takes out the components,
and the inertia counts show that none is missed.

Vectors that are null, empty or hold null, NaN, infinite or huge entries (from 2 ** 52 on, beyond a long's range once scaled) take no
part, nor do vectors of another than the commonest length (of the longest of these, if tied).  Null, repeated and tied ids, and
repeated vectors, are rows of their own.  Eigenvalues at the level of rounding have no component, so equal vectors, a single one or an
empty table give no rows.  A long vector costs its length squared in each task.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: A vector's entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
_EPS = np.finfo(float).eps


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the inertia of a pivoted L D L' factorization."""
    a = matrix - shift * np.eye(len(matrix))
    above, alpha = 0, (1 + 17**0.5) / 8
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diagonal(size)))
        r, s = np.unravel_index(int(np.argmax(size)), size.shape)
        if size[i, i] >= alpha * size[r, s]:
            block = [i]
        else:
            block = [int(r), int(s)]
        if size[r, s] == 0:
            return above
        rest = np.setdiff1d(np.arange(len(a)), block)
        pivot = a[np.ix_(block, block)]
        # a pivot of two has one eigenvalue on either side
        above += 1 if len(block) == 2 else int(pivot[0, 0] > 0)
        side = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return above


def _intervals(matrix: np.ndarray, k: int, most: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals of ``most`` eigenvalues at most, or as narrow as rounding allows, that hold the ``k`` largest."""
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-6)
    narrow = 64 * _EPS * len(matrix) * top
    low, high = 0.0, top  # below low: k or more lie above it; high: fewer than k
    while high - low > narrow:
        middle = (low + high) / 2
        n = eigenvalues_above(matrix, middle)
        if n >= k:
            low = middle
        if n == k:
            break
        if n < k:
            high = middle
    # borders with the number of eigenvalues above them
    open_, done = [(low, eigenvalues_above(matrix, low), top, 0)], []
    while open_:
        a, above_a, b, above_b = open_.pop()
        if above_a - above_b > most and b - a > narrow:
            middle = (a + b) / 2
            above = eigenvalues_above(matrix, middle)
            open_ += [(a, above_a, middle, above), (middle, above, b, above_b)]
        elif above_a > above_b:
            done.append((a, b, above_a - above_b))
    return done


def _filtered(matrix: np.ndarray, block: np.ndarray, low: float, high: float, points: int) -> np.ndarray:
    """The block under the contour integral of the resolvent around [low, high], by Gauss-Legendre points on the half circle."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(*np.polynomial.legendre.leggauss(points), strict=True):
        z = radius * np.exp(0.5j * np.pi * (1 - x))
        out += w / 2 * (z * np.linalg.solve((centre + z) * np.eye(len(matrix)) - matrix, block.astype(complex))).real
    return out


def feast(matrix: np.ndarray, k: int, most: int = 4, points: int = 8, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``k`` largest eigenvalues of a symmetric positive semidefinite matrix, falling.

    An interval is done when as many Ritz values lie in it as its inertia count says and their residuals are at the level of rounding.  A
    block that does not get there is doubled; at the full size Rayleigh-Ritz alone is exact.
    """
    d = len(matrix)
    vectors = []
    enough = 8 * d * _EPS * float(np.abs(matrix).sum(axis=1).max())
    for low, high, n in _intervals(matrix, k, most):
        size = min(d, 2 * n + 4)
        while True:
            block = np.random.default_rng(d).standard_normal((d, size))
            done = False
            for _ in range(rounds if size < d else 1):
                basis = np.linalg.qr(_filtered(matrix, block, low, high, points) if size < d else block)[0]
                ritz, turn = np.linalg.eigh(basis.T @ matrix @ basis)
                block = basis @ turn
                inside = (ritz > low) & (ritz <= high)
                left = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * ritz[inside], axis=0)
                done = inside.sum() == n and (left <= enough).all()
                if done:
                    break
            if size == d and not done:  # rounding moves a value over the border of a narrow interval: the nearest ones are meant
                inside = np.argsort(np.maximum(low - ritz, ritz - high))[:n]
            if done or size == d:
                vectors.append(block[:, inside])
                break
            size = min(d, 2 * size)
    if not vectors:
        return np.zeros(0), np.zeros((d, 0))
    # vectors of near values in two intervals become orthogonal
    basis = np.linalg.qr(np.concatenate(vectors, axis=1))[0]
    ritz, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return ritz[::-1][:k], (basis @ turn)[:, ::-1][:, :k]


@dataclass
class Whitening:
    """A fit: rows, exact sums by dimension, eigenvalues and unit eigenvectors (columns) of the covariance, its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(emb: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, v) of the rows that take part, their length); the length is 0 if none does."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float(1 << 52))))
    own = emb.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    size = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (own.where(F.size("v") == size.d), size.d) if size else (own, 0)


def _coordinates(b: pa.RecordBatch, d: int) -> np.ndarray:
    """The batch's vectors as whole numbers, one row each."""
    v = b.column(1)
    flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[len(v)].as_py()]
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + SHIFT


def _sum(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python numbers."""
    room = int(np.abs(x).max(initial=0)) * len(x) < 1 << 63
    return (x if room else x.astype(object)).sum(axis=0).astype(object)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y' y as Python numbers."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y if most < 1 << 63 else y.astype(object)
    return (y.T @ y).astype(object)


def _added(df: DataFrame, d: int, part) -> dict[tuple[int, int], int]:
    """The matrix of exact sums of ``part(coordinates)`` over all batches: added up in each task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                own = part(_coordinates(b, d))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.nonzero(np.tri(*total.shape, len(total[0]) - len(total)))  # a square's lower half, all of a row
            value = pa.array([Decimal(int(x)) for x in total[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), value], ["i", "j", "value"])

    rows = df.mapInArrow(run, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return {(r.i, r.j): int(r.value) for r in rows}


def fit(emb: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """((vec_id, v) of the rows that take part, the fit of their ``k`` leading components or None without rows)."""
    own, d = whole_vectors(emb, id_col, vector_col)
    if not d:
        return own, None
    # the sums of the dimensions and, as one more, the number of rows
    found = _added(own, d, lambda x: np.append(_sum(x), len(x))[None, :])
    n, sums = found[0, d], [found[0, j] for j in range(d)]
    centre = np.array([s // n for s in sums], np.int64)
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    products = _added(own, d, lambda x: _products(x - centre))
    matrix = np.zeros((d, d))
    for (i, j), value in products.items():
        matrix[i, j] = matrix[j, i] = (n * value - left[i] * left[j]) / (n * n)
    trace = sum(n * products[i, i] - left[i] ** 2 for i in range(d)) / (n * n)
    # what rounding alone can make of a zero is no component
    k = min(k, eigenvalues_above(matrix, 16 * d * _EPS * trace)) if trace > 0 else 0
    values, vectors = feast(matrix, k) if k else (np.zeros(0), np.zeros((d, 0)))
    return own, Whitening(n, sums, values, vectors, trace)


def transform(own: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of each row: its exact squared distance from the mean times n squared (null if no long holds it), and its components over the roots of their eigenvalues."""
    n, d = model.n, len(model.sums)
    sums, weights = model.sums, model.vectors / np.sqrt(model.values)
    kind = own.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _coordinates(b, d)
            room = int(np.abs(x).max(initial=0)) * n < 1 << 62
            away = n * (x if room else x.astype(object)) - np.array(sums, np.int64 if room else object)
            square = int(np.abs(away).max(initial=0)) ** 2 * d
            far = (away if square < 1 << 63 else away.astype(object)) ** 2
            far = [y if y < 1 << 63 else None for y in far.sum(axis=1).tolist()]
            white = (away / n).astype(float) @ weights
            offsets = np.arange(len(b) + 1, dtype=np.int32) * weights.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))], ["vec_id", "deviation", "whitened"])

    return own.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    means = rows.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col("whitened")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = rows.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(emb: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component, from 1 by falling eigenvalue."""
    own, model = fit(emb, k, id_col, vector_col)
    kind = own.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.values):
        return own.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = written(transform(own, model), "whitened")
    error = identity_error(rows, len(model.values))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
