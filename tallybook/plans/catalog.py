"""Registry of named queries: key -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or ledgers derived from them) in full.
Modules under :mod:`tallybook.plans` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.plans.oracle import ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(key: str, sql: str | None = None):
    """Register a query under ``key`` with its DuckDB oracle SQL (None: rows-only)."""
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    # Import for registration side effects.
    from tallybook.plans import (  # noqa: F401
        q_pnl,
        q_questions,
        q_clean,
        q_import,
        q_quota,
        q_chat,
        q_docs,
        q_messages,
        q_stream,
        q_store,
        q_ledger,
    )
