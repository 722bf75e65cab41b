"""The registry of queries: name to function, and name to the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register the function under its name; ``ctes`` go in front of ``sql``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return register
