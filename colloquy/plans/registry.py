"""Where queries and their oracle SQL are registered, by survey id and name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `oracle` is the equivalent SQL, where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from colloquy.plans import (  # noqa: F401
        aggregates,
        joins,
        rolequeries,
        scalars,
        sequencequeries,
        sourcequeries,
        textqueries,
        topk,
    )
