"""Registers queries of one plan module with their SQL."""

from __future__ import annotations

from ..sources import star


def registrar():
    """``QUERIES, SQL, query``: two tables, and a decorator that adds a query under its function's name."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None, tables: bool = True):
        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = star.sql(text) if tables else text.strip()
            return f

        return add

    return queries, sql, query
