"""Files as rows: scans by name pattern, a function for each file, round trips of tables and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number_in(path: Column, pattern: str) -> Column:
    """The first group of the pattern as a number, null where it does not match."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("long")


def scan(spark: SparkSession, folder: str, pattern: str, glob: str = "*", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """(number, path, content) of the files below a folder whose names match, in [lo, hi)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    found = files.withColumn("number", number_in(F.col("path"), pattern)).where("number IS NOT NULL")
    if lo is not None:
        found = found.where(F.col("number") >= lo)
    if hi is not None:
        found = found.where(F.col("number") < hi)
    return found.select("number", "path", "content")


def map_files(df: DataFrame, fn: Callable[[object], object], kind: str, key: str, content: str) -> DataFrame:
    """(key, result, error): the function of each content; one that raises gives a null and its message."""
    key_kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c in zip(b[key], b[content], strict=True):
                try:
                    rows.append((k, fn(c), None))
                except Exception as e:
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "result", "error"])

    return df.select(key, content).mapInPandas(run, f"{key} {key_kind}, result {kind}, error string")


def bucket_of(index: Column, size: int) -> Column:
    """The folder "lo-hi" of an index."""
    lo = F.floor(index / size) * size
    return F.concat(lo.cast("string"), F.lit("-"), (lo + size - 1).cast("string"))


def cached(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written from ``df`` if it is not there."""
    spark = df.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.parquet(path)
    return spark.read.parquet(path)
