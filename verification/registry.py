"""Registered queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from verification.views import Given, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), extra: str = ""):
    """Register ``f(given) -> DataFrame`` under ``name`` with its oracle SELECT."""

    def add(build: Callable[[Given], object]):
        QUERIES[name] = lambda spark, sf_dir: build(Given(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *views, extra=extra)
        return build

    return add


def load_all() -> None:
    from verification import (  # noqa: F401
        dashboard_queries,
        document_queries,
        evaluation_queries,
        scalar_queries,
        source_queries,
        stream_queries,
        upkeep_queries,
    )
