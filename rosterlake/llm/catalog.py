"""Registry of this subpackage's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name``, with SQL for the same rows where SQL can express them."""
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def load() -> None:
    """Import every module that registers queries, in the order of the operators."""
    from rosterlake.llm import (  # noqa: F401
        licenses, chat, toxicity, bpe, line_dedup, decontaminate, simhash, paragraph_sketch, language, pii,
        vector_codes, filter_audit, topk_search)
