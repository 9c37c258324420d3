"""Where query modules put their queries: a name, a function of (spark, sf_dir), and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import WITH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the adapters' names."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            # the adapters come first, before the query's own common table expressions
            own = sql.strip()
            ORACLES[name] = WITH + (", " + own.removeprefix("WITH ").removeprefix("RECURSIVE ") if own.startswith("WITH ") else own)
        return fn

    return add
