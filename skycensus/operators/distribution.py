"""Distributions of a catalogue's properties that a user can extend.

A distribution says where its raw values come from; cleaning, statistics, bins and sampling are the same for all.  Subclasses give
``raw`` and the class attributes; decorated with ``registered`` they are found by name.

    @registered("spread")
    class Spread(Distribution):
        share, log = 0.9, True

        def raw(self, tables):
            return tables["catalogue"].select(F.col("high") - F.col("low"))

Values that are null, no finite numbers or not positive are dropped, and so is what is not strictly below the ``share`` quantile of the rest.
Values of an empty distribution have no bins, and samples of it are null.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import number
from ..sources.storage import stored
from .dist import clean, statistics

DISTRIBUTIONS: dict[str, type["Distribution"]] = {}


def registered(name: str) -> Callable[[type["Distribution"]], type["Distribution"]]:
    """Register a distribution under a name."""

    def add(kind: type["Distribution"]) -> type["Distribution"]:
        if name in DISTRIBUTIONS:
            raise ValueError(f"a distribution named {name} is registered already")
        kind.name = name
        DISTRIBUTIONS[name] = kind
        return kind

    return add


def distribution_of(name: str, tables: Mapping[str, DataFrame], **options: object) -> "Distribution":
    """The registered distribution of that name over ``tables``; options replace its attributes."""
    if name not in DISTRIBUTIONS:
        raise ValueError(f"no distribution is named {name}; there are {', '.join(sorted(DISTRIBUTIONS))}")
    return DISTRIBUTIONS[name](tables, **options)


class Distribution(ABC):
    """The values of one property; ``tables`` are what ``raw`` reads, by name."""

    name = ""
    unit = ""
    #: The share of the positive values that is kept.
    share = 0.98
    #: Bins with equal ratios instead of equal widths, and their number of edges or bins.
    log = False
    bins = 100

    def __init__(self, tables: Mapping[str, DataFrame], **options: object) -> None:
        for k, v in options.items():
            if k not in ("unit", "share", "log", "bins"):
                raise TypeError(f"a distribution has no option {k}")
            setattr(self, k, v)
        self.tables = tables
        self._values: DataFrame | None = None
        self._counts: list[tuple[float, float, int]] | None = None

    @abstractmethod
    def raw(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """A table of one column: the values before cleaning."""

    def values(self) -> DataFrame:
        """(value): the cleaned values, stored at first use."""
        if self._values is None:
            raw = self.raw(self.tables)
            if len(raw.columns) != 1:
                raise ValueError(f"the raw values of {self.name or type(self).__name__} are one column, not {len(raw.columns)}")
            own = raw.toDF("value").select(number(F.col("value").cast("double")).alias("value"))
            self._values = stored(clean(own, "value", self.share), "values")
        return self._values

    def statistics(self) -> DataFrame:
        """One row: n, mean, median, std, p90, p95, p99."""
        return statistics(self.values(), "value")

    def _counted(self) -> list[tuple[float, float, int]]:
        """(low, high, count) of the bins, of which there are few; the last holds its upper edge."""
        if self._counts is None:
            ends = self.values().agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.log10(F.min("value")).alias("a"), F.log10(F.max("value")).alias("b")).first()
            if ends.lo is None:
                self._counts = []
                return self._counts
            # as many edges as ``bins`` where they are logarithmic, one more where they are not
            n = self.bins - 1 if self.log else self.bins
            lo, hi, x = (ends.a, ends.b, F.log10("value")) if self.log else (ends.lo, ends.hi, F.col("value"))
            if lo == hi:  # a single value has a unit's width around it
                lo, hi = lo - 0.5, hi + 0.5
            width = (hi - lo) / n
            place = F.greatest(F.lit(0), F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(n - 1)))
            found = {r.b: r["count"] for r in self.values().groupBy(place.alias("b")).count().collect()}
            edge = lambda i: 10 ** (lo + i * width) if self.log else lo + i * width
            self._counts = [(edge(i), edge(i + 1), found.get(i, 0)) for i in range(n)]
        return self._counts

    def histogram(self) -> DataFrame:
        """(bin, lo, hi, n) of all bins between the least and the greatest value."""
        rows = [(i, *b) for i, b in enumerate(self._counted())]
        return self.tables[next(iter(self.tables))].sparkSession.createDataFrame(rows, "bin int, lo double, hi double, n long")

    def sampled(self, rows: DataFrame, u: Column, out: str) -> DataFrame:
        """``rows`` with ``out``: the value at which the histogram's cumulative share reaches ``u`` (in [0, 1]), even within a bin."""
        filled = [b for b in self._counted() if b[2]]
        if not filled:
            return rows.withColumn(out, F.lit(None).cast("double"))
        total, up_to = sum(n for *_, n in filled), 0
        table = []
        for lo, hi, n in filled:
            table.append((lo, (hi - lo) / n, up_to / total, n))
            up_to += n
        low, slope, start, _ = (F.array(*(F.lit(float(x)) for x in column)) for column in zip(*table, strict=True))
        i = F.greatest(F.lit(0), F.size(F.filter(start, lambda s: s <= u)) - 1)
        return rows.withColumn(out, F.get(low, i) + (u - F.get(start, i)) * total * F.get(slope, i))


class ColumnDistribution(Distribution):
    """Values of one column of the table ``catalogue``, of resolved sources alone unless ``resolved_only`` is false."""

    column = ""
    resolved_only = True

    def raw(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        rows = tables["catalogue"]
        return (rows.where("resolved") if self.resolved_only else rows).select(self.column)


@registered("rms")
class Rms(ColumnDistribution):
    column, unit, share = "isl_rms", "mJy/beam", 0.95


@registered("las")
class Las(ColumnDistribution):
    column, unit, share = "las", "arcsec", 0.98


@registered("peak_flux")
class PeakFlux(ColumnDistribution):
    column, unit, share, log = "peak_flux", "mJy/beam", 0.98, True


@registered("redshift")
class Redshift(ColumnDistribution):
    column, unit, share = "z_best", "", 0.98


@registered("peak_pixel")
class PeakPixel(Distribution):
    """The greatest pixel of each of the table ``images``, in thousandths of their unit."""

    unit, share = "mJy/beam", 0.8

    def raw(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return tables["images"].select(F.array_max("image").cast("double") * 1000)
