"""Registered catalog queries (``QUERIES``) and their oracle SQL (``ORACLE``)."""

from __future__ import annotations


def all_queries():
    """Import every query module and return ``(QUERIES, ORACLE)``."""
    from lakeward.plans import catalog_change_queries, catalog_queries, change_queries, edge_queries, flagship, source_queries, stream_queries  # noqa: F401
    from lakeward.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
