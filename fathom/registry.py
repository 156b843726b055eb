"""Registered queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("relational", "retrieval", "filters", "graphs", "series", "changes", "pipelines", "statements")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query and, where SQL can say it, the oracle for it."""

    def register(f):
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return register


def _loaded() -> None:
    for name in MODULES:
        importlib.import_module(f"fathom.queries.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["dense_cosine"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _loaded()
    return _ORACLES
