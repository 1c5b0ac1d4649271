"""Registered queries, and the same results in the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .network import line_ctes, network_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, network: bool = True, recursive: bool = False, lines: str | None = None):
    """Registers a query by its function's name, with SQL over the network's CTEs, or over those of the network of lines with trips of the table ``lines``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{line_ctes(lines) if lines else network_ctes()} {sql}" if network else sql
        return f

    return add
