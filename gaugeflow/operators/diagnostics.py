"""Residual diagnostics, Q-Q points, variance inflation and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.distributions import normal_quantile
from gaugeflow.functions.scalar import correlation
from gaugeflow.operators.describe import correlation_matrix
from gaugeflow.operators.features import first_difference
from gaugeflow.plans import defaults
from gaugeflow.plans.ordered import order_rows, with_prior, with_rank


def jarque_bera(df: DataFrame, col: str) -> DataFrame:
    """n/6 (S^2 + K^2/4) with population moments; the p-value is exp(-JB/2)."""
    one = df.agg(F.count(col).alias("n"), F.skewness(col).alias("s"), F.kurtosis(col).alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return one.select(jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def durbin_watson(
    df: DataFrame,
    col: str,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    block_rows: int | None = None,
) -> DataFrame:
    """Sum of squared first differences over the sum of squares, in row order."""
    d = first_difference(df, col, order_cols, partition_cols, name="__d", block_rows=block_rows)
    e, diff = F.col(col), F.col("__d")
    return d.groupBy(*partition_cols).agg(
        F.try_divide(F.sum(diff * diff), F.sum(e * e)).alias("durbin_watson")
    )


def residual_summary(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias("mean_residual"), F.stddev_pop(col).alias("std_residual"))


def verdict_normality(p: Column) -> Column:
    return F.when(p > 0.05, "Residuals are approximately normal").otherwise("Residuals deviate from normality")


def verdict_autocorrelation(dw: Column) -> Column:
    return F.when((dw > 1.5) & (dw < 2.5), "No significant autocorrelation").otherwise(
        "Possible autocorrelation detected (expected for time-series)"
    )


def qq_points(
    df: DataFrame, col: str, id_cols: Sequence[str], *, block_rows: int | None = None
) -> DataFrame:
    """Ordered values against normal quantiles of Filliben's medians.

    Ranks come from block offsets, so the sort is spread over the cluster.
    """
    known = df.filter(F.col(col).isNotNull()).select(*id_cols, F.col(col).cast("double").alias("ordered_value"))
    o = order_rows(known, ["ordered_value", *id_cols], block_rows=block_rows)
    ranked = with_rank(o, "rank", total="n").result()
    n, rank = F.col("n"), F.col("rank")
    last = F.pow(F.lit(0.5), 1.0 / n)
    median = F.when(rank == 1, 1 - last).when(rank == n, last).otherwise((rank - 0.3175) / (n + 0.365))
    return ranked.withColumn("theoretical", normal_quantile(median))


def qq_line(points: DataFrame) -> DataFrame:
    return points.agg(
        F.regr_slope("ordered_value", "theoretical").alias("slope"),
        F.regr_intercept("ordered_value", "theoretical").alias("intercept"),
        correlation("ordered_value", "theoretical").alias("r"),
    )


def normality_at_scale(
    df: DataFrame, col: str, id_cols: Sequence[str], *, block_rows: int | None = None
) -> DataFrame:
    """Shapiro-Francia W' over all rows: squared correlation of the Q-Q points."""
    line = qq_points(df, col, id_cols, block_rows=block_rows).agg(
        F.count("*").alias("n"), correlation("ordered_value", "theoretical").alias("r")
    )
    return line.select((F.col("r") * F.col("r")).alias("statistic"), "n")


def residual_diagnostics(
    df: DataFrame,
    col: str,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    block_rows: int | None = None,
) -> DataFrame:
    """One row over all rows: W' and Jarque-Bera normality, Durbin-Watson within series, verdicts.

    The normality verdict takes the Jarque-Bera p-value, which holds for any large number of rows.
    Order columns need to be unique within a series only.
    """
    w = normality_at_scale(df, col, [*order_cols, *partition_cols], block_rows=block_rows)
    w = w.select("statistic").scalar()
    jb = jarque_bera(df, col).select(F.struct("statistic", "p_value").alias("s")).scalar()
    d = first_difference(df, col, order_cols, partition_cols, name="__d", block_rows=block_rows)
    squares = lambda c: F.sum(F.col(c) * F.col(c))
    dw = d.agg(F.try_divide(squares("__d"), squares(col))).scalar()
    out = residual_summary(df, col).withColumns(
        {
            "normality_statistic": w,
            "normality_p": jb["p_value"],
            "jarque_bera_statistic": jb["statistic"],
            "jarque_bera_p": jb["p_value"],
            "durbin_watson": dw,
        }
    )
    return out.withColumns(
        {
            "normality": verdict_normality(F.col("normality_p")),
            "autocorrelation": verdict_autocorrelation(F.col("durbin_watson")),
        }
    )


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation 1/(1 - R^2) of every feature on the others.

    The rows are read once for the p x p correlation matrix; the p small regressions
    are solved on that matrix.  A constant or exactly explained feature gives infinity.
    """
    cols = list(cols)
    cells = correlation_matrix(df.na.drop("any", subset=cols), cols).collect()
    corr = np.eye(len(cols))
    constant = {c["a"] for c in cells if c["i"] == c["j"] and c["r"] is None}
    for c in cells:
        if c["i"] != c["j"] and c["r"] is not None:
            corr[c["i"], c["j"]] = c["r"]
    out = []
    for i, name in enumerate(cols):
        others = [j for j, c in enumerate(cols) if j != i and c not in constant]
        unexplained = 1.0
        if others and name not in constant:
            beta = np.linalg.lstsq(corr[np.ix_(others, others)], corr[others, i], rcond=1e-12)[0]
            unexplained = 1.0 - float(corr[others, i] @ beta)
        infinite = name in constant or unexplained <= 1e-12
        out.append((name, float("inf") if infinite else 1.0 / unexplained))
    return df.sparkSession.createDataFrame(out, "feature string, vif double")


def permutation_importance(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    feature_cols: Sequence[str],
    label_col: str,
    id_cols: Sequence[str],
    *,
    task: str = "regression",
    repeats: int = 10,
    seed: int = defaults.SEED,
    block_rows: int | None = None,
) -> DataFrame:
    """Mean drop of R2 (or accuracy) when one feature is shuffled.

    A repeat orders rows by a seeded hash and gives each row the features of the row
    before it (the first takes the last's): every value is used exactly once.  All repeats
    and features share one ordering shuffle, with the repeat as the series, and the model scores a
    row once per repeat and feature.
    """
    features = list(feature_cols)
    base = df.select(*dict.fromkeys([*id_cols, label_col, *features]))
    drawn = base.withColumn("__repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    text = F.concat_ws("-", *[F.col(c).cast("string") for c in id_cols], (F.col("__repeat") + seed).cast("string"))
    drawn = drawn.withColumns(
        {"__h": F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), "__own": F.struct(*features)}
    )
    last = drawn.groupBy("__repeat").agg(F.max_by("__own", F.struct("__h", *id_cols)).alias("__last"))
    o = order_rows(drawn, ["__h", *id_cols], ["__repeat"], block_rows=block_rows)
    given = with_prior(o, "__own", lags={"__other": 1}).result().join(F.broadcast(last), "__repeat")  # a row per repeat
    given = given.withColumn("__other", F.coalesce("__other", "__last"))
    given = given.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = {f: F.when(F.col("feature") == f, F.col("__other")[f]).otherwise(F.col("__own")[f]) for f in features}
    shuffled = given.withColumns(swapped).drop("__h", "__own", "__other", "__last")
    scored = _score(predict(shuffled), label_col, task, ["feature", "__repeat"])
    every = _score(predict(base), label_col, task, []).scalar()
    mean = scored.groupBy("feature").agg(F.avg("score").alias("shuffled"))
    return mean.select("feature", (every - F.col("shuffled")).alias("importance"))


def _score(df: DataFrame, label_col: str, task: str, group_cols: list[str]) -> DataFrame:
    y, p = F.col(label_col).cast("double"), F.col("prediction")
    if task == "classification":
        return df.groupBy(*group_cols).agg(F.avg((y == p).cast("double")).alias("score"))
    return df.groupBy(*group_cols).agg((1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("score"))
