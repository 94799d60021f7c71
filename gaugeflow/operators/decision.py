"""Metric documents, model comparison tables and leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions import scalar

# Metrics a stored document may hold per model.
METRICS = (
    "rmse", "mae", "r2", "roc_auc", "pr_auc", "f1", "precision", "recall", "log_loss",
    "silhouette_score", "davies_bouldin_index", "n_clusters", "noise_ratio",
)
METRIC_TYPE = "map<string, struct<" + ", ".join(f"{m}: double" for m in METRICS) + ">>"


def metric_documents(model_col: str, metric_cols: Sequence[str]) -> Column:
    """JSON text ``{model: {metric: value}}`` of one row, the stored document form."""
    present = F.struct(*[F.col(m) for m in metric_cols])
    return F.to_json(F.create_map(F.col(model_col), present))


def flatten_metrics(df: DataFrame, json_col: str) -> DataFrame:
    """Nested metric documents to one row per model with one column per metric."""
    parsed = F.from_json(F.col(json_col), METRIC_TYPE)
    return df.select(F.explode(parsed).alias("model", "m")).select("model", "m.*")


def select_by_metric_keys(df: DataFrame, task: str) -> DataFrame:
    """Models that carry the metrics of a task (``regression`` or ``classification``)."""
    needed = {"regression": ("rmse", "r2"), "classification": ("f1", "precision", "recall")}[task]
    keep = F.lit(True)
    for m in needed:
        keep = keep & F.col(m).isNotNull()
    return df.filter(keep)


def select_by_suffix(df: DataFrame, task: str, model_col: str = "model") -> DataFrame:
    return df.filter(F.col(model_col).endswith(f"_{task}"))


def model_comparison(regression: DataFrame, classification: DataFrame, model_col: str = "model") -> DataFrame:
    """One row per model and task; a metric a task lacks is missing."""
    name = scalar.title_case(model_col).alias("model")
    reg = regression.select(name, F.lit("Regression").alias("task"), "rmse", "mae", "r2")
    clf = classification.select(
        name, F.lit("Classification").alias("task"), "roc_auc", "f1", "precision", "recall"
    )
    return reg.unionByName(clf, allowMissingColumns=True)


def leaderboard(df: DataFrame, task: str, model_col: str = "model") -> DataFrame:
    """Regression by RMSE ascending, classification by F1 descending, with the place.

    The table holds one row per model, so the unpartitioned rank is over that small set.
    """
    metric = F.col("rmse").asc() if task == "regression" else F.col("f1").desc()
    w = Window.orderBy(metric, model_col)
    return df.withColumn("place", F.row_number().over(w)).orderBy("place")


#: The four values at the head of a run's report: model and metric.
HEADLINE = {
    "linear_r2": ("linear_regression", "r2"),
    "logistic_auc": ("logistic_regression", "roc_auc"),
    "kmeans_silhouette": ("kmeans", "silhouette_score"),
    "mlp_r2": ("mlp_regression", "r2"),
}


def headline_metrics(flat: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row; ``wanted`` maps an output name to (model, metric)."""
    return flat.agg(
        *[F.max(F.when(F.col("model") == model, F.col(metric))).alias(name) for name, (model, metric) in wanted.items()]
    )
