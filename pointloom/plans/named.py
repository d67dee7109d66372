"""Register of named queries: each has a Spark plan and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def named(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under a name, with its oracle."""

    def put(query: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return put
