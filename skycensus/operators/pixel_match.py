"""Which image of another set an image is: candidates of near pixel sums, compared pixel by pixel.

Base images are ranked by their pixel sum.  A query's candidates are the base images at most ``reach`` ranks from the one whose sum is
nearest: the last below the query's sum or the first that is not (this one, if tied).  The first of them whose pixels are all within the tolerance is the match; without any, the candidate of the
smallest sum of absolute differences is the nearest image.

Sums of both sides are sorted in ranges, so nobody sees them all; ranks are cut into blocks, and rows within reach of a block's border are
copied to the block beside it.  Pixels are compared inside a block, without a shuffle for each candidate.  NaN pixels count nothing
in sums and match nothing; candidates of another number of pixels are passed over.  Keys are unique within a set; null images take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .metric_space import met

#: Ranks of a block.
BLOCK = 2048


def _ranked(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(side, key, v, t, rank): base rows (side 1) by their rank from 1, queries (side 0) by the number of base rows of a smaller sum."""
    spark = base.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["t", "side", "key"]
    both = base.withColumn("side", F.lit(1)).unionByName(queries.withColumn("side", F.lit(0)))
    ranged = stored(both.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "pixel-sums")
    sizes = ranged.groupBy("_part").agg(F.count_if(F.col("side") == 1).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    running = F.count_if(F.col("side") == 1).over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("rank", running).join(F.broadcast(before), "_part").withColumn("rank", F.col("rank") + F.col("_before")).drop("_part", "_before")


def match(queries: DataFrame, base: DataFrame, key: str, image: str, reach: int = 10, atol: float = 1e-6, rtol: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """(q, b, matched, difference): each query's match (difference 0) or nearest candidate; b is null where there is none."""
    total = F.aggregate(F.filter("v", lambda x: ~F.isnan(x)), F.lit(0.0), lambda a, x: a + x)
    whole = lambda df: df.where(F.col(image).isNotNull()).select(F.col(key).alias("key"), F.col(image).cast("array<double>").alias("v")).withColumn("t", total)
    ranked = stored(_ranked(whole(queries), whole(base)), "ranked-images")
    kind = base.schema[key].dataType.simpleString()
    # a query's nearest sum is that of the base row before it or after it
    edge = reach + 1
    asked = ranked.where("side = 0").select(F.floor(F.col("rank") / block).cast("int").alias("block"), F.col("key").alias("q"), "v", "t", "rank")
    first, last = F.floor((F.col("rank") - edge) / block), F.floor((F.col("rank") + edge) / block)
    rows = ranked.where("side = 1").select(F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("block"), F.col("key").alias("b"), F.col("v").alias("bv"), F.col("t").alias("bt"), F.col("rank").alias("b_rank"))

    def compare(some: pa.Table, of: pa.Table) -> pa.Table:
        place, matched, difference = [], [], []
        if len(some) and len(of):
            order = np.argsort(of["b_rank"].to_numpy(), kind="stable")
            ranks, sums = of["b_rank"].to_numpy()[order], of["bt"].to_numpy()[order]
            images, width = _images(of["bv"], order)
        for v, t, r in zip(some["v"], some["t"].to_pylist(), some["rank"].to_pylist(), strict=True):
            pixels = v.values.to_numpy(zero_copy_only=False)
            lo, hi = (np.searchsorted(ranks, r - reach), np.searchsorted(ranks, r + edge, "right")) if len(of) else (0, 0)
            near = np.arange(lo, hi)
            if len(near):
                below, above = near[ranks[near] == r], near[ranks[near] == r + 1]
                centre = r + 1 if len(above) and (not len(below) or sums[above[0]] - t <= t - sums[below[0]]) else r
                near = near[(np.abs(ranks[near] - centre) <= reach) & (width[near] == len(pixels))]
            if not len(near):
                place.append(None)
                matched.append(False)
                difference.append(None)
                continue
            off = np.abs(images[near, : len(pixels)] - pixels)
            same = (off <= atol + rtol * np.abs(pixels)).all(axis=1)
            apart = np.where(np.isnan(off), 0.0, off).sum(axis=1)
            best = int(np.argmax(same)) if same.any() else int(np.argmin(apart))
            place.append(int(order[near[best]]))
            matched.append(bool(same.any()))
            difference.append(0.0 if same.any() else float(apart[best]))
        return pa.table({"q": some["q"], "b": of["b"].take(pa.array(place, pa.int64())), "matched": pa.array(matched, pa.bool_()), "difference": pa.array(difference, pa.float64())})

    q_kind = queries.schema[key].dataType.simpleString()
    return met(asked, rows, compare, f"q {q_kind}, b {kind}, matched boolean, difference double", 2048).where("q IS NOT NULL")


def _images(v: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(images as rows, filled up with NaN, their numbers of pixels), in the given order."""
    lists = v.combine_chunks()
    width = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = np.full((len(lists), int(width.max(initial=0))), np.nan)
    start = lists.offsets.to_numpy()[:-1]
    at = np.repeat(np.arange(len(lists)), width)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)] = flat[np.repeat(start, width) + np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)]
    return out[order], width[order]
