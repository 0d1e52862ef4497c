"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query ``(session, directory) -> DataFrame`` under its function's name, with its SQL if it has one."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register
