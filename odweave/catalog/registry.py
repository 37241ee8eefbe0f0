"""Collects the queries of all sections."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from odweave.catalog.fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``key``, with its SQL over the tables and fixtures."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = with_fixtures(sql)
        return fn

    return register


for _section in (
    "sources", "verbs", "joins", "aggregates", "windows", "sorting", "reshape", "scalars", "network", "spatial",
    "enrichment", "model", "stats", "quality", "plans",
):
    import_module(f"odweave.catalog.{_section}")
