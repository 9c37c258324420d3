"""Round trips through stored tables and records, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIT_SCHEMA = "function STRING, x_space STRING, popt ARRAY<DOUBLE>, pcov ARRAY<ARRAY<DOUBLE>>, param_names ARRAY<STRING>, provenance STRING"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only in a local session where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skycensus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/skycensus/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, form: str = "parquet", **options: str) -> DataFrame:
    """Write a table and read it with the same schema."""
    path = shared_path(df.sparkSession, tag)
    df.write.format(form).options(**options).save(path)
    return df.sparkSession.read.format(form).schema(df.schema).options(**options).load(path)


def write_fits(df: DataFrame, path: str) -> None:
    """Fit records as JSON; the path names its kind."""
    if not path.endswith(".json"):
        raise ValueError("fit records go to a path that ends in .json")
    df.write.json(path)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """Fit records; one without a required field is an error when it is read."""
    if not path.endswith(".json"):
        raise ValueError("fit records are read from a path that ends in .json")
    rows = spark.read.schema(FIT_SCHEMA).json(path)
    return rows.withColumn("function", F.when(F.col("function").isNull() | F.col("x_space").isNull() | F.col("popt").isNull(), F.raise_error(F.lit("a fit record lacks a field"))).otherwise(F.col("function")))
