"""Registry of queries: modules add (name, query, SQL) with ``register``."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the function answers the query ``name``; ``sql`` is the same query in SQL."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable]:
    load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return _SQL


def load() -> None:
    """Import every module that registers queries."""
    from fathomline.plans import algorithms, bars, context, discovery, extras, market, models, quality, research, stats, wallets  # noqa: F401
