"""The catalog: every named query with its equivalent SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the plan modules, which register their queries."""
    from quillon.plans import code_plans, corpus_plans, detail_plans, framework_plans, graph_plans, knowledge_plans, search_plans, storage_plans, structure_plans  # noqa: F401
