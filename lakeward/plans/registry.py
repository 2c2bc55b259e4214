"""Registry of named catalog queries and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, projects the catalog from the driver's
tables there and runs one operator over the whole tables.  The oracle text
states the same question in SQL over the same projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeward.plans.oracle_ctes import with_catalog

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``; ``sql`` (if any) is its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_catalog(sql.strip())
        return fn

    return register
