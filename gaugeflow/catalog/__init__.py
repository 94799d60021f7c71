"""Named queries over the given tables, each with its DuckDB counterpart where SQL can say it."""

from gaugeflow.catalog import (  # noqa: F401
    aggregates,
    columns,
    decisions,
    inference,
    io,
    models,
    ordered_rows,
    streams,
)
from gaugeflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
