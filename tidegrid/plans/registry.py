"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with DuckDB SQL for the same rows if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from tidegrid.plans import audit, discovery, documents, evidence, extraction, graph, ingest, knowledge, market, news, pages, panel, relational, reports, search, segments, sheets, shipments  # noqa: E402, F401  they register
