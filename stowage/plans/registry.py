"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from stowage.plans import second_queries, table_queries, trace_queries

QUERIES = {**trace_queries.QUERIES, **second_queries.QUERIES, **table_queries.QUERIES}
ORACLE_SQL = {**trace_queries.ORACLE_SQL, **second_queries.ORACLE_SQL, **table_queries.ORACLE_SQL}
