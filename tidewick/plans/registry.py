"""What the modules of this package register: queries by name, and SQL for those that have it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: str, places: int = 6) -> str:
    """SQL for the rounding of tables.rounded."""
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"
