"""The registered queries and their DuckDB oracles."""

from __future__ import annotations

from .fixtures import oracle

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return put
