"""All registered queries and their SQL.

A query is a function of (spark, sf_dir); its SQL is what DuckDB runs on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the function under name."""

    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for part in ("tables", "tests", "charts", "compare", "learning", "service"):
    import_module(f"tallygrove.plans.queries_{part}")
