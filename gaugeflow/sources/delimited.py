"""Delimited text in and out: all columns read as text, then typed in one projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.cleaning import coerce_numeric
from gaugeflow.plans import defaults

_BLANK_HEADER = re.compile(r"^Unnamed|^_c\d+$")


class SchemaError(ValueError):
    """A table lacks columns that later stages depend on."""


def validate_schema(
    df: DataFrame, *, source: str = "input", required: Sequence[str] = defaults.REQUIRED_COLUMNS
) -> None:
    """Check column names only; no data is read."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"{source} is missing required columns: {missing}. Found: {sorted(df.columns)}.")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns with a blank header (trailing separators in the file)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not _BLANK_HEADER.search(c)])


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ";",
    text_cols: Sequence[str] = ("Date", "Time"),
    required: Sequence[str] | None = None,
) -> DataFrame:
    """Read a headed file: no type inference pass, blank columns dropped, numbers coerced."""
    df = drop_unnamed(spark.read.csv(path, sep=sep, header=True))
    if required is not None:
        validate_schema(df, source=path, required=required)
    return coerce_numeric(df, text_cols)


def write_delimited(df: DataFrame, path: str, *, sep: str = ",") -> None:
    """Headed text parts below ``path``; parent folders are created."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def read_table(spark: SparkSession, path: str, schema: str | None = None, *, sep: str = ",") -> DataFrame:
    """A delimited table written by ``write_delimited``; give the schema to skip inference."""
    reader = spark.read.option("sep", sep).option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def load_or_else(
    spark: SparkSession, path: str, read: Callable[[str], DataFrame], fallback: Callable[[], DataFrame]
) -> DataFrame:
    """The table at ``path``; if there is none, the fallback, written there as ``;`` text first."""
    try:
        return read(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    write_delimited(fallback(), path, sep=";")
    return read(path)
