"""Registry of the library's own queries: name -> builder, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that says the same."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


from scriptorium.plans import answers, corpus, facts, identifiers, imports, ingestion, linkage, operations, planning, records, relational, retrieval, rounds, sections, streams  # noqa: E402, F401
