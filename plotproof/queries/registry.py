"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from plotproof.queries.adapters import Domain
from plotproof.queries.sql import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, once: bool = False, **views: str):
    """Register ``fn(domain) -> DataFrame``; ``sql`` is expanded with the views it uses, materialised with ``once``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Domain(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, once, **views)
        return fn

    return register
