"""Registry of queries: a name, a function of a table getter, and the same query in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t(table_name)`` gives a frame."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(name)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: table(spark, sf_dir, n))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add
