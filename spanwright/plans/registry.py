"""Where query modules enter their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; without SQL it has a test of its own."""

    def enter(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries {name!r}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return enter
