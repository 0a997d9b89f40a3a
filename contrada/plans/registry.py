"""Registered queries over the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks with citation and evidence level of each zone's selected points."""
    return _queries["j6_j7_f4_grounded"](spark, sf_dir)


from . import evaluation_queries, poi_queries, source_queries  # noqa: E402, F401  they register themselves
