"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from textlode.plans import answers, aware, evidence, extraction, files, history, intake, knowledge, maintenance, memory, more, ranking, relational, retrieval, store, texts  # noqa: E402, F401
