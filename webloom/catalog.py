"""All queries of the engine by name, and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from webloom import operators, registry
from webloom.registry import Query
from webloom.session import ship_package


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(operators.__path__)):
        importlib.import_module(f"webloom.operators.{module}")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The best matches of a keyword query with their titles and snippets."""
    from webloom.plans.search import search

    return search(spark, folder, "crawler index -redirect", limit=20)


def _shipped(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(spark, folder)

    return run


def queries() -> dict[str, Query]:
    _load()
    return {name: _shipped(function) for name, function in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
