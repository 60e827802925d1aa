"""Registered queries: a name, a callable and, where SQL can express it, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import SQL as FIXTURES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
    """Registers a function under its name; `sql` follows the fixtures, and
    `more` is further common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"{FIXTURES}{', ' + more if more else ''} {sql}"
        return f

    return add
