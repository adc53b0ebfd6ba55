"""Named queries over the given tables, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load_all() -> None:
    from ragloom.plans import (  # noqa: F401
        catalog_chunking,
        catalog_conversation,
        catalog_graph,
        catalog_knowledge,
        catalog_metrics,
        catalog_retrieval,
        catalog_statistics,
        catalog_tables,
    )
