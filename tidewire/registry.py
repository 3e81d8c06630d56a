"""Every query of the library by name, and its SQL for the check against DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir)`` under ``name``, with its SQL where SQL can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tidewire.queries import aggregates, changes, gates, joins, rankings, texts, views  # noqa: F401
