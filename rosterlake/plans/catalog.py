"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory id, with the SQL it must agree with where SQL can express it."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def load() -> None:
    """Import every module that registers queries."""
    from rosterlake.plans import (  # noqa: F401
        campaign_queries, cleaning_queries, explore_queries, library_queries, matching_queries, resolution_queries,
        source_queries)
