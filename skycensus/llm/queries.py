"""One query for each operator of this package, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import ORACLE as OP9_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_column

    out = media_column(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("dct_hash")).alias("feature"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    model = fit(docs, _read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), F.round("p_toxic", 6).alias("p_toxic"), F.col("rejected").alias("toxic"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair_ids import read_shards, write_shards

    return read_shards(write_shards(_read(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_read(spark, sf_dir, "embeddings"))


#: Floor of 64 times each component, integer products, the 20 best of each query.
OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    return dedup_substrings(_read(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import near_duplicate_passages

    return near_duplicate_passages(_read(spark, sf_dir, "documents"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import trie

    return trie(_read(spark, sf_dir, "conversations"))


#: Lists of turns as keys; crc32 bit by bit, as the dialect has none; a node's subtree by comparing prefixes.
OP11_SQL = """
WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS u FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, u, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
          lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 4 AS h FROM t),
b AS (SELECT a.c, list_concat(coalesce(p.u[1:a.h], []), a.u[a.h + 1:]) AS v FROM h a LEFT JOIN t p ON p.c = a.c - a.c % 20),
m AS (SELECT c, len(v) AS n, unnest(range(0, len(v) + 1)) AS d, v FROM b),
k AS (SELECT c, n, d, v[1:d] AS p FROM m),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
                 CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(p[d]).x, '[^\x20\x09-\x0D]+')) END AS words FROM k GROUP BY p, d),
kids AS (SELECT a.p, count(b.d) AS n_children FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND b.p[1:a.d] = a.p GROUP BY a.p),
f AS (SELECT nodes.*, n_children FROM nodes JOIN kids USING (p)),
s AS (SELECT a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens FROM f a JOIN f b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.p)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (p) LEFT JOIN nodes q ON q.d = f.d - 1 AND q.p = f.p[1:f.d - 1]
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whiten import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_dedup": op1_suffix_dedup, "op2_packing": op2_packing, "op3_simhash": op3_simhash, "op4_topk": op4_topk, "op5_media": op5_media, "op6_passages": op6_passages, "op7_lm_score": op7_lm_score, "op8_token_ids": op8_token_ids, "op9_mixing": op9_mixing, "op10_toxicity": op10_toxicity, "op11_turn_trie": op11_turn_trie, "op12_whitening": op12_whitening, "op13_bpe": op13_bpe}
ORACLES: dict[str, str] = {"op4_topk": OP4_SQL, "op9_mixing": OP9_SQL, "op11_turn_trie": OP11_SQL}
