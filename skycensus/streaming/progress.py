"""Incremental jobs: files that are taken once, and completeness that grows with the trials that arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.binning import bin_of


def new_rows(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of files not taken before to a table; the checkpoint's log replaces flag files."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_once(trials: DataFrame, trial: str, time: str | None = None, within: str = "1 day") -> DataFrame:
    """The stream without trials that were seen before: state is kept by trial, in the query's checkpoint.

    A file that is delivered again therefore counts nothing.  With a column of event times, trials of one number that are at most ``within``
    apart count once and older state is dropped; without one, state grows with the number of trials.
    """
    if time is None:
        return trials.dropDuplicates([trial])
    return trials.withWatermark(time, within).dropDuplicatesWithinWatermark([trial])


def completeness_so_far(trials: DataFrame, edges: Sequence[float], flux: str = "mock_flux", detected: str = "detectable", trial: str | None = None) -> DataFrame:
    """Counts for each flux bin of a stream; the bins are finite, so their state is bounded without a watermark.  With ``trial``, each trial counts once."""
    if trial is not None:
        trials = each_once(trials, trial)
    return trials.withColumn("bin", bin_of(F.col(flux), edges)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col(detected)).alias("n_detected"))
