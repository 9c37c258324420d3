"""Values from the logs of a source finder: texts to which each run appends a block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
#: Patterns of the values.
TOTAL = r"Flux from sum of \(non-blank\) pixels[ .]*: " + _NUMBER
MODEL = r"Total flux density in model[ .]*: " + _NUMBER
MEAN = r"Raw mean \(Stokes I\) = +" + _NUMBER + " mJy"
RMS = r"raw rms = +" + _NUMBER + " mJy"


def latest_run(text: Column) -> Column:
    """The last block that is not blank; lines of = part the blocks."""
    return F.element_at(F.filter(F.split(text, r"(?m)^=+\s*$"), lambda x: F.trim(x) != ""), -1)


def value(block: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(block, pattern, 1), F.lit("")).cast("double")


def values(block: Column) -> Column:
    """(total, model, mean, rms, complete): a model flux that is not there is 0, other missing values are null."""
    total, mean, rms = value(block, TOTAL), value(block, MEAN), value(block, RMS)
    return F.struct(total.alias("total"), F.coalesce(value(block, MODEL), F.lit(0.0)).alias("model"), mean.alias("mean"), rms.alias("rms"), (total.isNotNull() & mean.isNotNull() & rms.isNotNull()).alias("complete"))
