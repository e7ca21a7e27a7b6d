"""Queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) under its function's name."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def load() -> None:
    from sourcelens.plans import evidence_queries, media_queries, policy_queries, source_queries, steps_queries, stream_queries, text_queries  # noqa: F401


load()
