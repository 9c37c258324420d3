"""Connected components of an edge table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def connected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node that has an edge to another.

    Alternating stars: each round links every node's larger neighbours to its smallest neighbour, then every node's
    neighbours to the smallest of them and itself.  The edges turn into stars in about log rounds; a hub's edges are
    aggregated before the shuffle only through their minimum, so no group of neighbours is collected.  Each round is a
    written table, so a lost executor costs one round.
    """
    one = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).distinct()
    now = written(one, "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        # large star: a node's larger neighbours go to the least of its neighbours and itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
