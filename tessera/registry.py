"""Named queries with their SQL twins; modules under ``tessera`` add to it when they are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as query ``name``, with SQL that gives the same rows."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return keep
