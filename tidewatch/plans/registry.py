"""All queries of the engine, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its name; sql: what a database must return for the same rows."""

    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def load() -> None:
    """Import the modules that hold queries."""
    from tidewatch.plans import evaluation_queries, scan_queries, segment_queries, series_queries, spectral_queries  # noqa: F401
