"""All queries of the library and their DuckDB oracles. Operator modules add theirs with ``query``; those over rows that are
written out (files of several kinds, replies, manifests) are ``example``s, which only the tests run."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from .plans.views import CTES

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
EXAMPLES: dict[str, Callable] = {}
MODULES = ("retrieval", "fusion", "vector_index", "text", "graph", "storage", "analytics", "joins", "streams", "ranking", "rules", "tables", "listings", "queries", "structure", "upkeep", "aliases", "segmenter", "versions", "archives")


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query and its oracle; ``views`` names the common views that the SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql:
            own = ", ".join(f"{v} AS ({CTES[v]})" for v in views.split())
            body = sql.strip()
            if own:
                deep = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
                rest = body.removeprefix("WITH ").removeprefix("RECURSIVE ")
                body = f"WITH {deep}{own}, {rest}" if body.startswith("WITH ") else f"WITH {own} {body}"
            ORACLES[name] = body
        return f

    return add


def example(name: str, sql: str | None = None, views: str = ""):
    """As ``query``, for the tests alone."""

    def add(f):
        query(name, sql, views)(f)
        EXAMPLES[name] = QUERIES.pop(name)
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessera.operators.{m}")
