"""Collects queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracle, register): ``@register(sql)`` files a query under its function name."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def register(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracle[fn.__name__] = sql
            return fn

        return add

    return queries, oracle, register
