"""Named queries with, where SQL can say the same, the SQL text."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``."""

    def wrap(fn):
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")
        REGISTRY[key] = (fn, sql)
        return fn

    return wrap
