"""All queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from . import admin_queries, io_queries, search_queries, store_queries, text_queries

PARTS = (store_queries, search_queries, text_queries, admin_queries, io_queries)


def queries():
    return {k: f for m in PARTS for k, f in m.R.queries.items()}


def oracle_sql():
    return {k: s for m in PARTS for k, s in m.R.sql.items()}


def flagship(spark, base):
    return search_queries.hybrid(spark, base)
