"""Flux transforms by name: parameters, forward and inverse as column expressions, and their JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linear:
    """y = k x"""

    name: ClassVar[str] = "linear"
    k: float

    def forward(self, x: Column) -> Column:
        return x * F.lit(float(self.k))

    def inverse(self, y: Column) -> Column:
        return y / F.lit(float(self.k))


@dataclass(frozen=True)
class Asinh:
    """y = k asinh(x / beta)"""

    name: ClassVar[str] = "asinh"
    k: float
    beta: float

    def forward(self, x: Column) -> Column:
        return F.asinh(x / F.lit(float(self.beta))) * F.lit(float(self.k))

    def inverse(self, y: Column) -> Column:
        return F.sinh(y / F.lit(float(self.k))) * F.lit(float(self.beta))


Transform = Linear | Asinh
TRANSFORMS: dict[str, type] = {}


def register(kind: type) -> type:
    """Make a transform known by its name; a name is taken once."""
    if kind.name in TRANSFORMS:
        raise ValueError(f"transform {kind.name} is registered twice")
    TRANSFORMS[kind.name] = kind
    return kind


for _kind in (Linear, Asinh):
    register(_kind)


def transform_of(source: Transform | dict) -> Transform:
    """A transform from its parameters, or as it is; an unknown name or a missing or odd parameter is an error."""
    if type(source) in TRANSFORMS.values():
        return source
    given = dict(source)
    name = given.pop("name", None)
    if name not in TRANSFORMS:
        raise ValueError(f"transform {name!r}; known are {', '.join(sorted(TRANSFORMS))}")
    try:
        return TRANSFORMS[name](**given)
    except TypeError as e:
        raise ValueError(f"parameters of {name}: {e}") from None


def save_transform(spark: SparkSession, transform: Transform, path: str) -> None:
    """One JSON record in a folder of any store that Spark can write."""
    record = json.dumps({"name": transform.name} | asdict(transform))
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_transform(spark: SparkSession, source: str | Transform | dict) -> Transform:
    """A transform from a JSON file, a folder with one, its parameters, or as it is."""
    if not isinstance(source, str):
        return transform_of(source)
    rows = spark.read.text(source, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one record is expected")
    return transform_of(json.loads(rows[0].value))


def fitted(df: DataFrame, x: str, kind: str, target: float, noise: float | None = None) -> Transform:
    """The transform that brings the column's standard deviation to ``target``; ``noise`` sets the asinh softening (three times it)."""
    if kind == "linear":
        return Linear(target / df.agg(F.stddev_pop(x).alias("s")).first().s)
    if kind != "asinh" or not noise:
        raise ValueError("a linear transform, or asinh with a noise level")
    return Asinh(target / df.agg(F.stddev_pop(F.asinh(F.col(x) / (3 * noise))).alias("s")).first().s, 3 * noise)
