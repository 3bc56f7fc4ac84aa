"""Registry that pairs every Spark query with its SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltable.functions.common import rounded
from voltable.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, places: int = 6):
    """Register `fn(views)`; `sql` is the final SELECT over the named SQL views."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda v: rounded(fn(v), places)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def as_callable(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QUERIES[name](Views(spark, folder))

    return run


def r(expr: str, places: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(({expr})::DOUBLE, {places}) + 0e0)"
