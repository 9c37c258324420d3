"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree.

Only DataFrame functions.  A source's documents fall into blocks by a hash; a mix takes every block of a source ``full`` times
(whole epochs) and then blocks in a permuted order until the rest of the target is met; the block at the border is cut at a
document.  The number of blocks drawn from each source is its quota.  A binary tree hands the quotas down: each node gives
half of its draws to the left child, and how many of each source these are is one multivariate-hypergeometric draw, made by
selection sampling with hashed uniforms.  A leaf is an output shard; it takes the next blocks of the source's permutation, so
shards are disjoint, and orders its documents by a local hash.

The number of blocks is bounded by ``most_blocks`` (a parameter: more blocks draw in finer steps and make the root of the tree larger)
and the number of sources, whatever the number of documents, and a hot source has as many blocks as its share.  All randomness is MD5 of ids and the seed, so reruns agree.

Contracts: a null text has size 0; sources sort by code point, null last, and weigh 1, 2, 3, repeating; rows with equal ids are
drawn each, and equal rows alike; documents of size 0 go with their block; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WORD = r"[^\x20\x09-\x0D]+"
SEED, LEAST_BLOCK_WORDS, MOST_BLOCKS, MOST_REPEATS = "7", 4096, 65_536, 3


def _digits(text: Column, first: int, n: int) -> Column:
    """``n`` hex digits of the text's MD5 from the ``first``, as a number."""
    return F.conv(F.substring(F.md5(text), first, n), 16, 10).cast("long")


def _named(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s:"), F.col(source)))


def sized(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, spread, place): the size in words and two hashes of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return narrow.withColumns({"spread": _digits(key, 1, 8), "place": _digits(key, 9, 12)})


def targets(sizes: DataFrame, weights: int = 3, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) for every source.

    ``target = min(cap, weight * level)``: of the sources in order of cap / weight the first ones are capped, and the level is
    what is left over the weights left, at the first place where the next source stays below its cap.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = Window.partitionBy()
    upto = Window.orderBy("filled_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = one.withColumn("rank", rank).withColumn("weight", (F.col("rank") - 1) % weights + 1).withColumn("cap", F.col("source_size") * most_repeats).withColumn("filled_at", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    levels = ranked.withColumn("here", level).withColumn("level", F.min(F.when(F.col("filled_at") >= F.col("here"), F.struct("filled_at", "rank", "here"))).over(every)["here"])
    open_ = F.col("weight") * F.col("level")
    return levels.select("source", "rank", "source_size", F.when(F.col("level").isNull() | (F.col("cap") <= open_), F.col("cap").cast("double")).otherwise(open_).alias("target"))


def draws(sizes: DataFrame, goals: DataFrame, seed: str = SEED, most_blocks: int = MOST_BLOCKS, least_block_words: int = LEAST_BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with their block, blocks with what is drawn of them)."""
    every = Window.partitionBy()
    block_words = F.greatest(F.lit(float(least_block_words)), F.sum("source_size").over(every) / most_blocks)
    goals = goals.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    docs = sizes.join(goals, same(sizes, goals)).drop(goals["source"]).withColumn("block", F.col("spread") % F.col("n_blocks"))
    blocks = docs.groupBy("source", "rank", "full", "rest", "block").agg(F.sum("size").alias("words"))
    order = _digits(F.concat(F.lit(f"{seed}:block:"), _named(), F.lit(":"), F.col("block").cast("string")), 1, 12)
    upto = Window.partitionBy("rank").orderBy("order", "block")
    blocks = blocks.withColumn("order", order).withColumn("end", F.sum("words").over(upto))
    last = F.when(F.col("end") <= F.col("rest"), "whole").when(F.col("end") - F.col("words") < F.col("rest"), "cut").otherwise("none")
    return docs, blocks.withColumn("last", last).withColumn("room", F.col("rest") - (F.col("end") - F.col("words")))


def _left_shares(level: int, seed: str) -> Column:
    """Of the node's ``parts`` (rank, k) and their ``total``: an array of (rank, k, x), x draws of k going left."""

    def one_source(acc: Column, part: Column) -> Column:
        def one_draw(a: Column, j: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), part["rank"], j), F.lit(1 << 31)).cast("double") / float(1 << 31)
            go = (u * a["left"] < a["free"]).cast("long")
            return F.struct((a["free"] - go).alias("free"), (a["left"] - 1).alias("left"), (a["x"] + go).alias("x"))

        none_yet = F.struct(acc["free"].alias("free"), acc["left"].alias("left"), F.lit(0).cast("long").alias("x"))
        done = F.aggregate(F.sequence(F.lit(1).cast("long"), part["k"]), none_yet, one_draw)
        share = F.struct(part["rank"].alias("rank"), part["k"].alias("k"), done["x"].alias("x"))
        return F.struct(done["free"].alias("free"), done["left"].alias("left"), F.concat(acc["out"], F.array(share)).alias("out"))

    start = F.struct(F.expr("total div 2").alias("free"), F.col("total").alias("left"), F.array().cast("array<struct<rank:int,k:bigint,x:bigint>>").alias("out"))
    return F.aggregate("parts", start, one_source)["out"]


def split_quotas(quotas: DataFrame, levels: int, seed: str = SEED) -> DataFrame:
    """(shard, rank, k): the quotas (rank, k) handed down a tree of ``levels`` levels to 2 ** levels shards.

    At a node with K draws the left child gets K // 2.  Draw after draw goes left with the probability (left's free places) /
    (draws left), which makes the sources' numbers on the left multivariate-hypergeometric.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "rank", "k")
    for level in range(levels):
        gathered = nodes.where("k > 0").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "k"))).alias("parts"), F.sum("k").alias("total"))
        drawn = gathered.select("node", F.explode(_left_shares(level, seed)).alias("o"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("o.x").alias("k")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("o.k") - F.col("o.x")).alias("k")))
        nodes = drawn.select(F.col("o.rank").alias("rank"), F.explode(sides).alias("side")).select("side.node", "rank", "side.k")
    return nodes.select(F.col("node").alias("shard"), "rank", "k").where("k > 0")


def mix(docs: DataFrame, shards: int = 16, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_blocks: int = MOST_BLOCKS, least_block_words: int = LEAST_BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, shards): a row for each document; ``shards`` has one entry for each copy."""
    if shards & (shards - 1):
        raise ValueError("shards is a power of two")
    sizes = written(sized(docs, seed, id_col, text_col, source_col), "sizes")
    goals = targets(sizes)
    placed, blocks = draws(sizes, goals, seed, most_blocks, least_block_words)
    # a draw is a block in an epoch; draws of a source in permuted order have the numbers 1 to k
    epochs = F.sequence(F.lit(1), F.col("full") + F.when(F.col("last") == "none", 0).otherwise(1))
    drawn = blocks.where("full > 0 OR last <> 'none'").select("rank", "block", "last", F.explode(epochs).alias("epoch"))
    turn = _digits(F.concat(F.lit(f"{seed}:draw:"), F.col("rank").cast("string"), F.lit(":"), F.col("block").cast("string"), F.lit(":"), F.col("epoch").cast("string")), 1, 12)
    drawn = written(drawn.withColumn("number", F.row_number().over(Window.partitionBy("rank").orderBy(turn, "block", "epoch"))), "draws")
    quotas = drawn.groupBy("rank").agg(F.count("*").alias("k"))
    leaves = split_quotas(quotas, shards.bit_length() - 1, seed)
    ends = leaves.withColumn("end", F.sum("k").over(Window.partitionBy("rank").orderBy("shard")))
    numbers = ends.select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("k") + 1, F.col("end"))).alias("number"))
    to = drawn.join(numbers, ["rank", "number"]).groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("copies"))
    state = blocks.select("rank", "block", "last", "room").join(to, ["rank", "block"], "left")
    rows = placed.join(state, ["rank", "block"])
    # documents of a cut block, in the order of their hash, up to the room in it: beyond it the block's last draw leaves them out
    cut = rows.where("last = 'cut'").withColumn("cut_end", F.sum("size").over(Window.partitionBy("rank", "block").orderBy("place", "doc_id", "size").rangeBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("less", (F.col("cut_end") - F.col("size") / 2 > F.col("room")).cast("int")).drop("cut_end")
    rows = rows.where("last <> 'cut'").withColumn("less", F.lit(0)).unionByName(cut)
    # what a document gives is what of its block's draws has come down the tree
    reached = F.coalesce(F.col("copies"), F.array().cast("array<struct<epoch:int,shard:bigint>>"))
    mine = F.transform(F.slice(reached, F.lit(1), F.greatest(F.size(reached) - F.col("less"), F.lit(0))), lambda c: c["shard"])
    return rows.withColumn("shards", mine).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", "place")


def shuffled(mixed: DataFrame) -> DataFrame:
    """(shard, position, doc_id): the copies of a mix in each shard's local order."""
    copies = mixed.select("doc_id", "place", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64("shard", "copy", "place")
    return copies.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy(order, "doc_id", "copy"))).select("shard", "position", "doc_id", "copy")


def mixed_documents(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: int) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, dealt to the output shards and in each one's local order; rows that it does
    not take go.

    A shard is a partition of the result (and a file, once written).  ``shards`` is a power of two; by default the first one
    that reaches the number of shuffle partitions.  Rows that share an id and a source share the decision of one of them.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 1 << max(0, partitions - 1).bit_length()
    of = {c: f"o{i}" for i, c in enumerate(docs.columns)}  # no column of the input can clash with those used here
    mixed = mix(docs, shards, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    one = mixed.groupBy("doc_id", "source").agg(F.max(F.struct(F.size("shards").alias("n"), "shards", "place")).alias("best")).where("best.n > 0")
    rows = docs.select(*(F.col(c).alias(o) for c, o in of.items()))
    taken = rows.join(one, F.col(of[id_col]).eqNullSafe(F.col("doc_id")) & F.col(of[source_col]).cast("string").eqNullSafe(F.col("source")))
    copies = taken.select(*of.values(), "best.place", F.posexplode("best.shards").alias("copy", "shard"))
    dealt = copies.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", F.xxhash64("shard", "copy", "place"), of[id_col], "copy")
    return dealt.select(*(F.col(o).alias(c) for c, o in of.items()))


#: The same sizes, targets and draws for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / CAST((rank - 1) % 3 + 1 AS DOUBLE) AS filled_at FROM s1),
s3 AS (SELECT *, CAST((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER w)::BIGINT, 0) AS DOUBLE)
              / CAST((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER w)::BIGINT, 0) AS DOUBLE) AS here
       FROM s2 WINDOW w AS (ORDER BY filled_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT here AS level FROM s3 WHERE filled_at >= here ORDER BY filled_at, rank LIMIT 1),
g0 AS (SELECT source, rank, source_size, CASE WHEN level IS NULL OR cap <= weight * level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target
       FROM s3 LEFT JOIN lv ON true),
g AS (SELECT *, greatest(1, CAST(ceil(source_size / greatest(4096e0, CAST((sum(source_size) OVER ())::BIGINT AS DOUBLE) / 65536e0)) AS BIGINT)) AS n_blocks,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_ FROM g0),
p AS (SELECT d.doc_id, d.size, d.source, g.rank, g.source_size, g.target, g.full_, g.target - g.full_ * g.source_size AS rest,
        ('0x' || substr(h, 1, 8))::BIGINT % g.n_blocks AS block, ('0x' || substr(h, 9, 12))::BIGINT AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b0 AS (SELECT source, rank, rest, block, sum(size)::BIGINT AS words FROM p GROUP BY ALL),
b1 AS (SELECT *, (sum(words) OVER (PARTITION BY rank ORDER BY ('0x' || substr(md5('7:block:' || CASE WHEN source IS NULL THEN 'n' ELSE 's:' || source END || ':' || CAST(block AS VARCHAR)), 1, 12))::BIGINT, block
        ROWS UNBOUNDED PRECEDING))::BIGINT AS end_ FROM b0),
r AS (SELECT p.*, b1.end_, b1.words, (sum(p.size) OVER (PARTITION BY p.rank, p.block ORDER BY place, doc_id, size RANGE UNBOUNDED PRECEDING))::BIGINT AS cut_end
      FROM p JOIN b1 ON p.rank = b1.rank AND p.block = b1.block)
SELECT doc_id, size, source_size, target,
  CAST(size * (full_ + CASE WHEN end_ <= rest THEN 1 WHEN end_ - words < rest AND cut_end - size / 2e0 <= rest - (end_ - words) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
