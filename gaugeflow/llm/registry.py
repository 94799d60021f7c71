"""Queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None, also: tuple[str, ...] = ()):
    """Register ``fn(table DataFrame) -> DataFrame`` as a query, with its DuckDB text where there is one.

    ``also`` names further tables that ``fn`` takes after the first.
    """

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (table, *also)])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap
