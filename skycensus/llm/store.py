"""Tables that one stage writes and a later one reads, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders and tables of this session that ``release`` may delete.
_folders: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in a local session where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skycensus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts lineage: what follows does not run ``df`` again, and survives the loss of any executor.  With ``keep``, ``release`` leaves it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skycensus/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if not keep:
        _folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, by: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a new table bucketed by a column, as many buckets as there are shuffle partitions, and read it back."""
    spark = df.sparkSession
    name = f"skycensus_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("compression", compression).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Delete what operators have written so far; call it once their results are stored, for they read from it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _folders:
        path = hadoop.Path(_folders.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
