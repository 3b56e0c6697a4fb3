"""Registered queries: a name, a Spark form over the tables in a folder, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function under a name."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def load() -> None:
    from tidemark.plans import access, changes, chat, ingest, scalars, search  # noqa: F401
