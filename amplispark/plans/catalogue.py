"""Every assay query of this package with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The modules of this package that register queries.
TOPICS = ("sequences", "grades", "search", "copies", "kernels", "reports", "windows", "chemistry", "outcomes", "floors", "coverage", "verdicts", "audit", "groups", "basics")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Adds a query, and its SQL where SQL can express it."""
    if name in _QUERIES:
        raise ValueError(f"query {name!r} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _ORACLES[name] = sql


def _load() -> None:
    for topic in TOPICS:
        importlib.import_module(f"amplispark.plans.{topic}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
