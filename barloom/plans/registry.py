"""Where each family of queries registers what it offers."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under its name, with its DuckDB equivalent."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add
