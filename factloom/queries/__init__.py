"""Registered queries of the core: name -> callable, name -> SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("integrity", "facts", "ingest", "text", "search", "quality", "streams")


def collect() -> tuple[dict, dict]:
    """All core queries and the SQL of those that SQL can express."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"factloom.queries.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
