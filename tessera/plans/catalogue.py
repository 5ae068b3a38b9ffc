"""How queries are registered: a name, a function of the inputs, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of Inputs as a query, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        from tessera.plans.adapters import Inputs

        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return add
