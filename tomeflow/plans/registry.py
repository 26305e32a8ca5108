"""Where the driver queries are collected: a name, a Spark callable and, when it can be said, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}


def query(name: str, row: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``row`` names the SURVEY rows it covers, ``sql`` its DuckDB form."""
    from .bindings import Tables

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ROWS[name] = row
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
