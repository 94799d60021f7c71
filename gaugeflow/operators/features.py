"""Calendar, lag and rolling features without target leakage, and the model matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.operators.cleaning import numeric_columns
from gaugeflow.plans import defaults
from gaugeflow.plans.ordered import Ordered, block_rows_of, keys_at_rank, order_rows, with_prior, with_rank

SMALLEST_CUT_BLOCK = 20_000


def calendar_features(df: DataFrame, ts_col: str = defaults.TIME) -> DataFrame:
    sin, cos = scalar.cyclical(scalar.hour_of(ts_col), 24)
    return df.withColumns(
        {
            "Hour": scalar.hour_of(ts_col),
            "DayOfWeek": scalar.weekday_of(ts_col),
            "Month": scalar.month_of(ts_col),
            "IsWeekend": scalar.is_weekend(ts_col),
            "Season": scalar.season_of(ts_col),
            "Hour_sin": sin,
            "Hour_cos": cos,
        }
    )


def lag_features(
    df: DataFrame,
    value_col: str,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    lags: Sequence[int] = defaults.LAGS,
    prefix: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``<prefix>_lag_<k>h``: the value k rows earlier."""
    prefix = prefix or value_col
    o = order_rows(df, order_cols, partition_cols, block_rows=block_rows)
    return with_prior(o, value_col, lags={f"{prefix}_lag_{k}h": k for k in lags}).result()


def rolling_mean_prior(
    df: DataFrame,
    value_col: str,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    windows: Sequence[int] = defaults.ROLLING,
    prefix: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``<prefix>_roll_mean_<n>h``: mean of up to n earlier rows, never the current one."""
    prefix = prefix or value_col
    o = order_rows(df, order_cols, partition_cols, block_rows=block_rows)
    return with_prior(o, value_col, means={f"{prefix}_roll_mean_{n}h": n for n in windows}).result()


def first_difference(
    df: DataFrame,
    value_col: str,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    name: str = "difference",
    block_rows: int | None = None,
) -> DataFrame:
    o = order_rows(df, order_cols, partition_cols, block_rows=block_rows)
    out = with_prior(o, value_col, lags={"__prior": 1}).result()
    return out.withColumn(name, F.col(value_col) - F.col("__prior")).drop("__prior")


def feature_frame(
    df: DataFrame | Ordered,
    *,
    value_col: str = defaults.TARGET,
    ts_col: str = defaults.TIME,
    order_cols: Sequence[str] | None = None,
    partition_cols: Sequence[str] = (),
    threshold: float = defaults.REGULATORY_THRESHOLD,
    lags: Sequence[int] = defaults.LAGS,
    windows: Sequence[int] = defaults.ROLLING,
    prefix: str = "NO2",
    flag_col: str = defaults.FLAG,
    block_rows: int | None = None,
) -> DataFrame:
    """All model features in one plan: one shuffle and one sort on the series key.

    Pass an ``Ordered`` frame to continue on an existing row order (and its shuffle).
    """
    if isinstance(df, Ordered):
        o = df
    else:
        o = order_rows(df, order_cols or [ts_col], partition_cols, block_rows=block_rows)
    o = with_prior(
        o,
        value_col,
        lags={f"{prefix}_lag_{k}h": k for k in lags},
        means={f"{prefix}_roll_mean_{n}h": n for n in windows},
    )
    out = calendar_features(o.result(), ts_col)
    return out.withColumn(flag_col, scalar.exceeds(value_col, threshold)).na.drop("any")


def feature_columns(
    df: DataFrame, exclude: Sequence[str] = (defaults.TIME, defaults.TARGET, defaults.FLAG)
) -> list[str]:
    """Numeric columns that may enter a model, in table order."""
    return numeric_columns(df, exclude)


def assemble(
    df: DataFrame, feature_cols: Sequence[str], label_col: str, output_col: str = "features"
) -> DataFrame:
    """Feature vector and DOUBLE label; a missing feature is an error, not a silent skip."""
    vector = VectorAssembler(inputCols=list(feature_cols), outputCol=output_col, handleInvalid="error")
    return vector.transform(df).withColumn("label", F.col(label_col).cast("double"))


def chronological_split(
    df: DataFrame,
    order_cols: Sequence[str] = (defaults.TIME,),
    partition_cols: Sequence[str] = (),
    *,
    train_ratio: float = defaults.TRAIN_RATIO,
    val_ratio: float = defaults.VAL_RATIO,
    name: str = "split",
    block_rows: int | None = None,
) -> DataFrame:
    """Label rows ``train``, ``val`` or ``test`` by position in time; the rest is test.

    Without partition columns the rows are not ranked: the two cut keys are located by
    block counts, and every row is compared with them, with no shuffle of the table.
    """
    ratios = (train_ratio, train_ratio + val_ratio)
    if partition_cols:
        o = with_rank(order_rows(df, order_cols, partition_cols, block_rows=block_rows), "__rank", total="__total")
        inside = [F.col("__rank") <= F.floor(F.col("__total") * F.lit(r)) for r in ratios]
        out = o.result()
    else:
        keys = df.select(*order_cols)
        n = keys.count()
        ends = [int(n * r) for r in ratios]
        # only the blocks that hold a cut are sorted, so small blocks pay even on small tables
        block_rows = min(block_rows_of(df, block_rows), max(SMALLEST_CUT_BLOCK, n // 32))
        o = order_rows(keys, order_cols, block_rows=block_rows, rows=n)
        cuts = keys_at_rank(o, [min(e, n - 1) for e in ends]) if n else [None, None]
        key = F.struct(*order_cols)
        inside = [F.lit(True) if e >= n else key < cut for e, cut in zip(ends, cuts)]
        out = df
    label = F.when(inside[0], F.lit("train")).when(inside[1], F.lit("val")).otherwise(F.lit("test"))
    return out.withColumn(name, label).drop("__rank", "__total")
