"""Regression and classification metrics, curves and threshold analysis."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.plans import defaults
from gaugeflow.plans.ordered import Ordered, order_rows, points_at_or_below, running_sums

EPS = sys.float_info.epsilon


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def residuals(df: DataFrame, label_col: str, prediction_col: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(label_col) - F.col(prediction_col))


def regression_metrics(
    df: DataFrame, label_col: str, prediction_col: str, group_cols: Sequence[str] = ()
) -> DataFrame:
    """RMSE, MAE and R2 in a single aggregate."""
    y = F.col(label_col).cast("double")
    e = y - F.col(prediction_col)
    sums = df.groupBy(*group_cols).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var")
    )
    mse, var = F.col("mse"), F.col("var")
    r2 = F.when(var > 0, 1 - mse / var).when(mse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(*group_cols, F.sqrt(mse).alias("rmse"), "mae", r2.alias("r2"))


def _confusion(label: Column, pred: Column) -> list[Column]:
    def count(y: int, p: int, name: str) -> Column:
        return F.count(F.when((label == y) & (pred == p), 1)).alias(name)

    return [count(0, 0, "tn"), count(0, 1, "fp"), count(1, 0, "fn"), count(1, 1, "tp")]


def confusion_counts(
    df: DataFrame, label_col: str, prediction_col: str, group_cols: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*group_cols).agg(*_confusion(F.col(label_col), F.col(prediction_col)))


def classification_metrics(
    df: DataFrame,
    label_col: str,
    prediction_col: str,
    score_col: str | None = None,
    group_cols: Sequence[str] = (),
    *,
    block_rows: int | None = None,
) -> DataFrame:
    """Precision, recall, F1 and confusion counts; with scores also AUC, AP and log-loss."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    aggs = _confusion(F.col(label_col), F.col(prediction_col))
    if score_col:
        aggs.append(F.avg(_loss(F.col(label_col), F.col(score_col))).alias("log_loss"))
    out = df.groupBy(*group_cols).agg(*aggs)
    out = out.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )
    if not score_col:
        return out
    areas = curve_areas(df, label_col, score_col, group_cols, block_rows=block_rows)
    if group_cols:
        return out.join(areas, list(group_cols))
    area = areas.select(F.struct("roc_auc", "pr_auc").alias("s")).scalar()
    return out.withColumns({"roc_auc": area["roc_auc"], "pr_auc": area["pr_auc"]})


def _loss(y: Column, p: Column) -> Column:
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return -F.when(y == 1, F.ln(clipped)).otherwise(F.ln(1 - clipped))


def log_loss(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg(_loss(F.col(label_col), F.col(score_col))).alias("log_loss"))


# ---------------------------------------------------------------- curves


def running_totals(
    df: DataFrame,
    label_col: str,
    score_col: str,
    group_cols: Sequence[str] = (),
    *,
    block_rows: int | None = None,
) -> Ordered:
    """Cumulative true and false positives over distinct scores, highest first.

    Rows are first reduced to one per score (map-side combined), then summed with
    block totals so that no group of scores is sorted in one task.
    """
    y = F.col(label_col)
    per_score = df.groupBy(*group_cols, F.col(score_col).cast("double").alias("score")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg")
    )
    per_score = per_score.withColumn("__desc", -F.col("score"))
    o = order_rows(per_score, ["__desc"], group_cols, block_rows=block_rows, rows=df.count())
    return running_sums(o, {"tp": "pos", "fp": "neg"}, {"n_pos": "pos", "n_neg": "neg"})


def curve_areas(
    df: DataFrame,
    label_col: str,
    score_col: str,
    group_cols: Sequence[str] = (),
    *,
    block_rows: int | None = None,
) -> DataFrame:
    """Area under the ROC curve (ties grouped) and average precision (step sum)."""
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    cum = running_totals(df, label_col, score_col, group_cols, block_rows=block_rows).result()
    sums = cum.groupBy(*group_cols).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(neg * (tp - pos / 2)).alias("area"),
        F.sum(pos * (tp / (tp + fp))).alias("steps"),
    )
    p, n = F.col("p"), F.col("n")
    return sums.select(
        *group_cols,
        F.try_divide(F.col("area"), p * n.cast("double")).alias("roc_auc"),
        F.when(p > 0, F.col("steps") / p).otherwise(F.lit(0.0)).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (), **kw) -> DataFrame:
    return curve_areas(df, label_col, score_col, group_cols, **kw).select(*group_cols, "roc_auc")


def average_precision(
    df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (), **kw
) -> DataFrame:
    return curve_areas(df, label_col, score_col, group_cols, **kw).select(*group_cols, "pr_auc")


def roc_curve(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (), **kw) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score, starting at (0, 0) with no threshold."""
    cum = running_totals(df, label_col, score_col, group_cols, **kw).result()
    points = cum.select(
        *group_cols,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )
    start = df.groupBy(*group_cols).agg(
        F.first(F.lit(None).cast("double")).alias("threshold"),
        F.max(F.lit(0.0)).alias("fpr"),
        F.max(F.lit(0.0)).alias("tpr"),
    )
    return start.unionByName(points)


def pr_curve(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (), **kw) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, closing at recall 0, precision 1."""
    cum = running_totals(df, label_col, score_col, group_cols, **kw).result()
    points = cum.select(
        *group_cols,
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "n_pos"), F.lit(1.0)).alias("recall"),
    )
    end = df.groupBy(*group_cols).agg(
        F.first(F.lit(None).cast("double")).alias("threshold"),
        F.max(F.lit(1.0)).alias("precision"),
        F.max(F.lit(0.0)).alias("recall"),
    )
    return points.unionByName(end)


def calibration_bins(
    df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = (), n_bins: int = 10
) -> DataFrame:
    """Fraction positive and mean score per non-empty bin; an edge value falls in the lower bin."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    score = F.col(score_col)
    binned = F.size(F.filter(edges, lambda e: e < score))
    return df.groupBy(*group_cols, binned.alias("bin")).agg(
        F.avg(F.col(label_col).cast("double")).alias("fraction_positive"), F.avg(score).alias("mean_predicted")
    )


# ---------------------------------------------------------------- decision thresholds


def threshold_sweep(
    df: DataFrame,
    label_col: str,
    score_col: str,
    group_cols: Sequence[str] = (),
    *,
    tp_benefit: float = defaults.TP_BENEFIT,
    fp_cost: float = defaults.FP_COST,
    fn_cost: float = defaults.FN_COST,
    tn_benefit: float = defaults.TN_BENEFIT,
    n_thresholds: int = defaults.N_THRESHOLDS,
) -> DataFrame:
    """F1 and expected value at every threshold, from one histogram pass.

    Each score is counted once, at the number of thresholds it reaches; descending
    sums over at most ``n_thresholds + 1`` cells give the counts at each threshold.
    """
    groups = list(group_cols)
    grid = F.array(*[F.lit(t) for t in scalar.threshold_grid(n_thresholds)])
    y = F.col(label_col)
    reached = points_at_or_below(grid, n_thresholds, F.col(score_col).cast("double"))
    cells = df.groupBy(*groups, reached.alias("cell")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg")
    )
    packed = cells.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("cell", F.struct("pos", "neg").alias("v")))).alias("cells")
    )
    dense = packed.select(*groups, "cells", F.explode(F.sequence(F.lit(0), F.lit(n_thresholds))).alias("cell"))
    at = F.try_element_at("cells", F.col("cell"))
    dense = dense.select(
        *groups, "cell", F.coalesce(at["pos"], F.lit(0)).alias("pos"), F.coalesce(at["neg"], F.lit(0)).alias("neg")
    )
    w = Window.partitionBy(*groups).orderBy(F.col("cell").desc())
    whole = Window.partitionBy(*groups)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    swept = (
        dense.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
        .withColumns({"fn": F.sum("pos").over(whole) - tp, "tn": F.sum("neg").over(whole) - fp})
        .filter(F.col("cell") > 0)
        .withColumn("threshold", F.element_at(grid, F.col("cell")))
    )
    return swept.select(
        *groups, "threshold", "tp", "fp", "fn", "tn",
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp * tp_benefit - fp * fp_cost - fn * fn_cost + tn * tn_benefit).alias("expected_value"),
    )


def argmax_first(
    df: DataFrame, metric_col: str, position_col: str, group_cols: Sequence[str] = (), name: str = "best"
) -> DataFrame:
    """Position of the highest metric; ties go to the lowest position."""
    return df.groupBy(*group_cols).agg(
        F.max_by(position_col, F.struct(F.col(metric_col), -F.col(position_col))).alias(name)
    )


def best_threshold(swept: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Lowest threshold that maximises F1, and the one that maximises expected value."""
    first = -F.col("threshold")
    return swept.groupBy(*group_cols).agg(
        F.max_by("threshold", F.struct("f1", first)).alias("best_f1_threshold"),
        F.max_by("threshold", F.struct("expected_value", first)).alias("best_ev_threshold"),
    )
