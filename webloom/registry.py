"""Where operators register the queries that show them, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql says the same for an independent engine."""

    def register(function: Query) -> Query:
        if function.__name__ in QUERIES:
            raise ValueError(f"two queries named {function.__name__}")
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = " ".join(sql.split())
        return function

    return register
