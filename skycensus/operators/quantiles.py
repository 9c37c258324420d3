"""Exact quantiles of a column of any size, by repeated range histograms.

All wanted ranks are narrowed at once.  A round cuts each bracket that still holds a wanted rank at splitters from a mergeable sketch and
counts what lies between and on them; the counts say exactly where the ranks are.  A splitter's own rows are a bin apart, so
however many rows share a value, a rank among them is found at once.  When a bracket holds few rows, the values at the ranks are
read from it.  A task holds sketches, counts, or the rows of one such bracket; the driver holds a bracket for each rank and group.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.sky import number

#: Rows of a bracket that are looked at one by one, splitters of a round, and the sketch's accuracy.
LEAF, SPLITTERS, ACCURACY = 10_000, 128, 2000
#: Groups whose brackets the driver holds.
MOST_GROUPS = 100_000


@dataclass
class _Bracket:
    """Rows of a group strictly between two values (None: no border), ``n`` of them after ``before`` others, with the wanted ranks there."""

    group: tuple
    low: float | None
    high: float | None
    before: int
    n: int
    ranks: set[int] = field(default_factory=set)


def _rows_of(rows: DataFrame, keys: Sequence[str], brackets: Sequence[_Bracket], more: Sequence[tuple[str, str, Sequence]] = ()) -> DataFrame:
    """(_b, _x, more columns): the rows that lie in a bracket, with its number; a row lies in one bracket at most."""
    spark = rows.sparkSession
    kinds = [StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)]
    schema = StructType([*kinds, StructField("_b", LongType()), StructField("_low", DoubleType()), StructField("_high", DoubleType())])
    extra = ", ".join(f"{name} {kind}" for name, kind, _ in more)
    for f in spark.createDataFrame([], extra).schema if extra else ():
        schema = schema.add(f)
    table = spark.createDataFrame([(*b.group, i, b.low, b.high, *[values[i] for *_, values in more]) for i, b in enumerate(brackets)], schema)
    inside = (F.col("_low").isNull() | (F.col("_x") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_x") < F.col("_high")))
    same = inside
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(table), same)


def _narrowed(rows: DataFrame, keys: Sequence[str], brackets: list[_Bracket], found: dict[tuple, dict[int, float]]) -> list[_Bracket]:
    """One round: smaller brackets around the ranks that are not found."""
    shares = [i / SPLITTERS for i in range(SPLITTERS + 1)]
    sketch = _rows_of(rows, keys, brackets).groupBy("_b").agg(F.percentile_approx("_x", shares, ACCURACY).alias("s")).collect()
    cuts = {r["_b"]: sorted(set(r.s)) for r in sketch}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 2 i + 1: on splitter i; 2 i: below it and above the one before
        seen: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            of, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in np.unique(of).tolist():
                own, edges = x[of == i], np.array(cuts[i])
                place = np.searchsorted(edges, own, "left") + np.searchsorted(edges, own, "right")
                for p, n in zip(*np.unique(place, return_counts=True), strict=True):
                    seen[i, int(p)] += int(n)
        if seen:
            columns = [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.int64()), pa.array([*seen.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_b", "p", "n"])

    counted: dict[int, dict[int, int]] = defaultdict(dict)
    parts = _rows_of(rows, keys, brackets).select("_b", "_x").mapInArrow(count, "_b long, p long, n long")
    for r in parts.groupBy("_b", "p").agg(F.sum("n").alias("n")).collect():
        counted[r["_b"]][r.p] = r.n
    out = []
    for i, b in enumerate(brackets):
        edges, before, left = cuts[i], b.before, sorted(b.ranks)
        for p in sorted(counted[i]):
            n = counted[i][p]
            here = {k for k in left if before <= k < before + n}
            if here and p % 2:
                found[b.group].update(dict.fromkeys(here, edges[p // 2]))
            elif here:
                out.append(_Bracket(b.group, edges[p // 2 - 1] if p else b.low, edges[p // 2] if p // 2 < len(edges) else b.high, before, n, here))
            before += n
    return out


def _read(rows: DataFrame, keys: Sequence[str], brackets: list[_Bracket], found: dict[tuple, dict[int, float]]) -> None:
    """The values at the ranks of brackets of few rows."""
    wanted = [sorted(b.ranks) for b in brackets]
    table = _rows_of(rows, keys, brackets, [("_at", "array<int>", [[k - b.before for k in w] for b, w in zip(brackets, wanted, strict=True)])])
    values = F.sort_array(F.collect_list("_x"))
    for r in table.groupBy("_b").agg(values.alias("v"), F.first("_at").alias("at")).select("_b", F.transform("at", lambda k: F.get("v", k)).alias("v")).collect():
        found[brackets[r["_b"]].group].update(zip(wanted[r["_b"]], r.v, strict=True))


def quantiles(df: DataFrame, x: Column | str, shares: Sequence[float], by: Sequence[str] = (), leaf: int = LEAF) -> dict[tuple, tuple[int, list[float]]]:
    """By group: (number of values, their quantiles with linear interpolation).  Nulls, NaN and infinities are no values; a group without any is left out.

    The groups are few (snapshots, bins): the driver holds each one's brackets.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], number(F.col(x) if isinstance(x, str) else x).cast("double").alias("_x")).where("_x IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0").limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"quantiles of more than {MOST_GROUPS} groups")
    found: dict[tuple, dict[int, float]] = defaultdict(dict)
    open_ = []
    for r in sizes:
        ranks = {k for p in shares for k in (math.floor(p * (r.n - 1)), math.ceil(p * (r.n - 1)))}
        open_.append(_Bracket(tuple(r[k] for k in keys), None, None, 0, r.n, ranks))
    while open_:
        few = [b for b in open_ if b.n <= leaf]
        if few:
            _read(rows, keys, few, found)
        many = [b for b in open_ if b.n > leaf]
        open_ = _narrowed(rows, keys, many, found) if many else []
    out = {}
    for r in sizes:
        group = tuple(r[k] for k in keys)
        values = []
        for p in shares:
            at = p * (r.n - 1)
            low, high = found[group][math.floor(at)], found[group][math.ceil(at)]
            values.append(low if low == high else low + (high - low) * (at - math.floor(at)))
        out[group] = (r.n, values)
    return out


def quantile_table(df: DataFrame, x: Column | str, shares: Mapping[str, float], by: Sequence[str] = (), leaf: int = LEAF) -> DataFrame:
    """(by.., the named quantiles): a row for each group with values; without groups one row, of nulls where there are no values."""
    found = quantiles(df, x, list(shares.values()), by, leaf)
    schema = StructType([*[StructField(c, df.schema[c].dataType) for c in by], *[StructField(name, DoubleType()) for name in shares]])
    rows = [(*group, *values) for group, (_, values) in found.items()]
    return df.sparkSession.createDataFrame(rows if rows or by else [(None,) * len(shares)], schema)


def median(df: DataFrame, x: Column | str) -> float | None:
    got = quantiles(df, x, [0.5])
    return got[()][1][0] if got else None


def mad(df: DataFrame, x: Column | str) -> float | None:
    """The median distance from the median, by two runs."""
    x = F.col(x) if isinstance(x, str) else x
    centre = median(df, x)
    return None if centre is None else median(df, F.abs(x - F.lit(centre)))
