"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MODULES = ("q_features", "q_intake", "q_extract", "q_rules", "q_decode", "q_score", "q_cascade", "q_signals", "q_output", "q_store", "q_prep", "q_evals", "q_ml", "q_stream")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, if SQL can express it, its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"textguard.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
