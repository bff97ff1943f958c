"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "multisect_search"


def query(name: str, sql: str | None = None):
    """Register a query callable, with DuckDB SQL where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put
