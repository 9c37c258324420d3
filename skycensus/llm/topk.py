"""Exact top-k inner-product search over norm buckets with local cosine thresholds.

Candidates are sorted by length (norm) over range partitions and cut into buckets of bounded size, each one row with its ids
and matrix; queries form blocks in the same way.  The longest bucket gives every query a first k-th best score.  With it, a
query's local threshold in a bucket is score / (query length * longest length of the bucket): above 1 the bucket is skipped;
below ``COORDINATE_FROM`` candidates are pruned by length (a prefix of the bucket, since it is sorted); between, by the feasible
interval of the query's largest coordinates.  What is left is verified by integer products.  Block pairs are joined on the
bucket's number, and only those that some query cannot skip.  A block holds at most ``BLOCK`` vectors, so all tasks are bounded,
and copies of a vector are cut like any others because ids break ties.

Contracts: vectors that are null, or hold a null or a component that is not finite, take no part; empty vectors score 0; of
vectors of different lengths the shorter counts as padded with zeros; a query is not its own candidate, but another row with
the same values is; ties go to the smaller id; rows with equal ids are one vector each.  Components of an absolute value up to
2 ** 40 are exact; beyond 2 ** 53 in a product sum, Python integers are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

K, SCALE, BLOCK, COORDINATE_FROM, FOCUS = 20, 64.0, 4096, 0.6, 3


def quantized(vectors: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double> of whole numbers, norm) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = F.col(vec_col).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    return vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """One row for at most ``size`` vectors: (n, dim, longest, shortest, ids, matrix), in order of falling norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), size):
                s = b.slice(i, size)
                ids = s.column(0).to_numpy()
                rows = [np.asarray(x.as_py(), np.float64) for x in s.column(1)]
                dim = max(map(len, rows), default=0)
                m = np.zeros((len(rows), dim))
                for r, x in enumerate(rows):
                    m[r, : len(x)] = x
                norm = s.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([dim], pa.int32()), pa.array([norm.max()]), pa.array([norm.min()]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["n", "dim", "longest", "shortest", "ids", "matrix"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.select("vec_id", "v", (-F.col("norm")).alias("_far"), "norm").repartitionByRange(n, "_far", "vec_id").sortWithinPartitions("_far", "vec_id")
    return ordered.select("vec_id", "v", "norm").mapInArrow(run, "n int, dim int, longest double, shortest double, ids binary, matrix binary")


def _unpack(n: int, dim: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.float64).reshape(n, dim)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == w else np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products of rows with rows."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).sum(1).max() * np.abs(c).max() < 2.0**53:
        return (q @ c.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in q], dtype=object)


def best_in_bucket(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, coordinate_from: float = COORDINATE_FROM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of query, candidate id, score): each query's k best of a bucket, of those that can reach its ``floor``.

    ``floor`` is a score that k candidates are known to reach (-inf: none known).  A candidate that equals it is kept.
    """
    q, c = _same_width(q, c)
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    longest = c_len.max(initial=0.0)
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * longest > 0, floor / (q_len * longest), np.where(floor > 0, np.inf, -np.inf))
    rows: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    scores: list[np.ndarray] = []

    def keep(row: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        ok = (q_ids[row] != c_ids[cand]) & (score >= floor[row])
        rows.append(row[ok])
        ids.append(c_ids[cand[ok]])
        scores.append(score[ok])

    alive = np.flatnonzero(local <= 1 + slack)
    by_length = alive[~(local[alive] > coordinate_from)]
    by_coordinate = alive[local[alive] > coordinate_from]
    # length pruning: only candidates of length >= floor / query length can do; they are the first of the bucket
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(q_len[by_length] > 0, floor[by_length] / q_len[by_length], -np.inf)
    upto = np.searchsorted(-c_len, -(need - slack * np.maximum(1, np.abs(need))), side="right")
    order = np.argsort(upto, kind="stable")
    for i in range(0, len(order), 256):
        part = order[i : i + 256]
        n = int(upto[part].max())
        score = _products(q[by_length[part]], c[:n])
        inside = np.arange(n)[None, :] < upto[part][:, None]
        inside &= q_ids[by_length[part]][:, None] != c_ids[None, :n]
        inside &= score >= floor[by_length[part]][:, None]
        if n > 4 * k and score.dtype != object:  # the k-th best of the row itself
            masked = np.where(inside, score, np.iinfo(np.int64).min)
            inside &= score >= np.partition(masked, n - k, axis=1)[:, n - k, None]
        r, s = np.nonzero(inside)
        keep(by_length[part][r], s, score[r, s])
    # coordinate pruning: the candidate's direction must lie in the interval that each focus coordinate allows
    if len(by_coordinate):
        unit = c / np.where(c_len > 0, c_len, 1)[:, None]
        sorted_at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in by_coordinate.tolist():
            direction = q[r] / q_len[r]
            t = min(1.0, local[r])
            allowed = None
            for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS].tolist():
                if f not in sorted_at:
                    at = np.argsort(unit[:, f], kind="stable")
                    sorted_at[f] = at, unit[at, f]
                at, value = sorted_at[f]
                middle, reach = direction[f] * t, np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - direction[f] ** 2))
                high = 1.0 if direction[f] >= t else middle + reach
                low = -1.0 if direction[f] <= -t else middle - reach
                a, b = np.searchsorted(value, low - slack), np.searchsorted(value, high + slack, side="right")
                here = np.zeros(len(c), bool)
                here[at[a:b]] = True
                allowed = here if allowed is None else allowed & here
            cand = np.flatnonzero(allowed)
            keep(np.full(len(cand), r), cand, _products(q[r : r + 1], c[cand])[0] if len(cand) else np.zeros(0, np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, cand, score = (np.concatenate(x) for x in (rows, ids, scores))
    order = np.lexsort((cand, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], cand[i])), np.int64)
    row, cand, score = row[order], cand[order], score[order]
    first = np.searchsorted(row, row)
    top = np.arange(len(row)) - first < k
    return row[top], cand[top], score[top]


def top_k(vectors: DataFrame, query_filter: str = "vec_id % 20 = 0", k: int = K, scale: float = SCALE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates."""
    all_ = quantized(vectors, scale, id_col, vec_col)
    numbered = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    buckets = written(numbered(_blocks(all_, block), "bucket"), "buckets", "uncompressed")
    queries = written(numbered(_blocks(all_.where(query_filter), block), "block"), "queries", "uncompressed")
    # the longest bucket is one row of at most ``block`` vectors
    first = buckets.orderBy(F.desc("longest"), "bucket").limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = _unpack(first[0].n, first[0].dim, bytes(first[0].ids), bytes(first[0].matrix))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, dim, ids, matrix in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("n", "dim", "ids", "matrix")), strict=True):
                q_ids, q = _unpack(n, dim, ids, matrix)
                row, _, score = best_in_bucket(q_ids, q, np.full(n, -np.inf), *top, k)
                found = np.bincount(row, minlength=n)
                floor = np.full(n, -np.inf)
                ends = np.cumsum(found)
                full = found == k
                floor[full] = score[ends[full] - 1].astype(np.float64)
                out.append((floor.tobytes(), _least_reach(q, floor)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.float64())], [*b.schema.names, "floors", "least"])

    floors = queries.mapInArrow(seed, type(queries.schema)([*queries.schema.fields]).add("floors", "binary").add("least", "double"))
    floors = written(floors, "floors", "uncompressed")
    # number the buckets (one narrow row for each), list them for each block, and keep the pairs that some query cannot skip
    spans = buckets.select("bucket", "longest", F.row_number().over(Window.orderBy(F.desc("longest"), "bucket")).alias("number"))
    n_buckets = buckets.count()
    wanted = floors.select("block", "least", F.explode(F.sequence(F.lit(1), F.lit(n_buckets))).alias("number")).join(spans, "number").where("longest >= least").select("block", "bucket")
    sides = wanted.join(floors.select("block", F.struct("n", "dim", "ids", "matrix", "floors").alias("q")), "block").join(buckets.select("bucket", F.struct("n", "dim", "ids", "matrix").alias("c")), "bucket")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                q, c = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                q_ids, qm = _unpack(q["n"], q["dim"], q["ids"], q["matrix"])
                row, cand, score = best_in_bucket(q_ids, qm, np.frombuffer(q["floors"], np.float64), *_unpack(c["n"], c["dim"], c["ids"], c["matrix"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(row + b.column(2)[i].as_py() * block), pa.array(cand), pa.array(score.tolist(), pa.int64())], ["query_id", "query_row", "vec_id", "score"])

    found = sides.select("q", "c", "block").mapInArrow(verify, "query_id long, query_row long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least_reach(q: np.ndarray, floor: np.ndarray) -> float:
    """The least length that a candidate needs to reach some query's floor."""
    length = np.sqrt((q * q).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(length > 0, floor / length, np.where(floor > 0, np.inf, -np.inf))
    return float(need.min()) * (1 - 1e-9) if np.isfinite(need.min()) else -1.0
