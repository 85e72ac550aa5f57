"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from metriclake.plans.ctes import with_tables
from metriclake.sources.derived import Tables

MODULES = ("facts", "coverage", "pages", "graph", "lake", "text", "evidence", "reports", "alerts", "audits", "streams")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str, recursive: bool = False):
    """Register a function of the tables as a query, with the SQL that its rows must equal."""

    def register(make: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = with_tables(sql, *tables, recursive=recursive)
        return make

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"metriclake.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
