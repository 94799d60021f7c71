"""Standardisation with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import scalar


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> Column:
    """Means and population deviations as a scalar-subquery struct, read once per plan."""
    parts = []
    for c in cols:
        parts += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return df.agg(F.struct(*parts).alias("s")).scalar()


def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace ``cols`` by their z-scores; statistics come from ``fit_on`` (e.g. the train rows)."""
    return df.withColumns(scalar.standardize(cols, scaler_stats(df if fit_on is None else fit_on, cols)))


def scaler_stage(train: DataFrame, cols: Sequence[str], prefix: str = "z_") -> SQLTransformer:
    """A persistable pipeline stage that adds ``z_<column>`` with fitted constants."""
    stats = []
    for c in cols:
        x = F.col(c).cast("double")
        stats += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = train.agg(*stats).first()
    if any(row[f"m_{c}"] is None for c in cols):
        raise ValueError("cannot fit a scaler on columns without values")
    exprs = []
    for c in cols:
        mean, std = row[f"m_{c}"], row[f"s_{c}"]
        exprs.append(f"(`{c}` - {mean!r}D) / {std if std > 0 else 1.0!r}D AS `{prefix}{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def busy_partitions(df: DataFrame) -> DataFrame:
    """A stored table that is read many times, dealt out if its files are too few to keep all cores busy.

    Larger tables keep the partitions of their files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
