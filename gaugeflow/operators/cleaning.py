"""Typing, sentinel removal, gap filling and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions import scalar
from gaugeflow.plans import defaults
from gaugeflow.plans.ordered import fill_linear, order_rows


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def coerce_numeric(df: DataFrame, keep_text: Sequence[str] = ("Date", "Time")) -> DataFrame:
    """Every column except ``keep_text`` becomes a DOUBLE; unparseable text is missing."""
    return df.select(
        *[F.col(f"`{c}`") if c in keep_text else scalar.coerce_number(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def parse_datetime(
    df: DataFrame, date_col: str = "Date", time_col: str = "Time", ts_col: str = defaults.TIME
) -> DataFrame:
    """Join a day-first date and a time into one timestamp; an existing one is kept."""
    if date_col in df.columns and time_col in df.columns:
        return df.withColumn(ts_col, scalar.parse_day_first(date_col, time_col)).drop(date_col, time_col)
    if ts_col not in df.columns:
        raise ValueError(f"Neither {date_col}/{time_col} nor {ts_col} is among the columns")
    return df


def drop_missing_key(df: DataFrame, ts_col: str = defaults.TIME) -> DataFrame:
    return df.na.drop(subset=[ts_col])


def sentinel_to_null(
    df: DataFrame, sentinel: float = defaults.MISSING_SENTINEL, cols: Sequence[str] | None = None
) -> DataFrame:
    """Values exactly equal to the sentinel become missing in every numeric column."""
    cols = numeric_columns(df) if cols is None else cols
    return df.withColumns({c: scalar.null_if(c, sentinel) for c in cols})


def missing_fraction(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, fraction)`` in one pass over the table."""
    cols = numeric_columns(df) if cols is None else list(cols)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("fraction")) for c in cols]))
    )


def drop_sparse_columns(
    df: DataFrame, max_fraction: float = defaults.MAX_MISSING_FRACTION, cols: Sequence[str] | None = None
) -> DataFrame:
    """Drop numeric columns missing in strictly more than ``max_fraction`` of the rows."""
    cols = numeric_columns(df) if cols is None else list(cols)
    if not cols:
        return df
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if shares[c] is not None and shares[c] > max_fraction])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def interpolate_linear(
    df: DataFrame,
    value_cols: Sequence[str],
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    limit: int = defaults.GAP_LIMIT,
    block_rows: int | None = None,
) -> DataFrame:
    return fill_linear(order_rows(df, order_cols, partition_cols, block_rows=block_rows), value_cols, limit).result()


def clean_series(
    df: DataFrame,
    *,
    ts_col: str = defaults.TIME,
    order_cols: Sequence[str] | None = None,
    partition_cols: Sequence[str] = (),
    sentinel: float = defaults.MISSING_SENTINEL,
    max_missing: float = defaults.MAX_MISSING_FRACTION,
    limit: int = defaults.GAP_LIMIT,
    block_rows: int | None = None,
) -> DataFrame:
    """Parse time, remove sentinels, drop sparse columns, fill short gaps, drop the rest."""
    order_cols = list(order_cols or [ts_col])
    df = drop_missing_key(parse_datetime(df, ts_col=ts_col), ts_col)
    values = numeric_columns(df, [*order_cols, *partition_cols])
    df = drop_sparse_columns(sentinel_to_null(df, sentinel, values), max_missing, values)
    values = [c for c in values if c in df.columns]
    return drop_any_null(
        interpolate_linear(df, values, order_cols, partition_cols, limit=limit, block_rows=block_rows)
    )


def sort_chronological(df: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """Total order by range partitioning; operators themselves do not need it."""
    return df.orderBy(*order_cols)


def sample_rows(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = defaults.SEED) -> DataFrame:
    """``n`` rows without replacement: the smallest seeded hashes, the same on every run."""
    drawn = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))
    return df.orderBy(drawn, *id_cols).limit(n)


def time_range(df: DataFrame, ts_col: str, now, past_hours: int = 24, forecast_days: int = 3) -> DataFrame:
    """Rows from ``past_hours`` before to ``forecast_days`` after ``now``, both ends kept.

    ``now`` is a parameter (text or column) so that the result can be repeated.
    """
    at = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    start = at - F.make_dt_interval(hours=F.lit(past_hours))
    end = at + F.make_dt_interval(days=F.lit(forecast_days))
    return df.filter(F.col(ts_col).between(start, end))
