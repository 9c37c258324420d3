"""A corpus pipeline of five stages: severity filter, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.llm.mixing import mixed_documents
from skycensus.llm.packing import pack
from skycensus.llm.simhash import drop_near_duplicates
from skycensus.llm.store import release, written
from skycensus.llm.suffix_dedup import without_repeats
from skycensus.llm.toxicity import fit, score

#: No SQL can express the fitted model or the tokenizer.
ORACLE_SQL = None
#: A passage of over 50 words.
PASSAGE_WORDS = 51


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("NOT rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 400-byte strings and passages of over 50 words that occur twice; ``n_chars`` follows the text."""
    kept = without_repeats(docs, words=PASSAGE_WORDS)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _released(stage: Stage) -> Stage:
    """The stage, after what the stages before it have left in the shared folder is deleted: their results are written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _released(toxicity)),
    ("simhash near-dedup", _released(near_duplicates)),
    ("suffix-array dedup", _released(repeated_passages)),
    ("mixing", _released(mixing)),
    ("packing", _released(packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
