"""Regression and classification estimators.

Linear and logistic regression are persistable MLlib pipelines that standardise with population
deviations and assemble the features; bagged, randomised and boosted trees are the models of
``random_trees`` and ``boosting``. Defaults are the configured settings, and ``predict`` scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.boosting import BoostedTrees, fit_boosted_trees
from gaugeflow.operators.random_trees import RandomForest, fit_bagged_trees, fit_random_trees
from gaugeflow.operators.scaling import busy_partitions, scaler_stage
from gaugeflow.plans import defaults
from gaugeflow.session import cut_lineage


def _fit(
    train: DataFrame, features: Sequence[str], label: str, estimator: Estimator, *, repeated: bool = True
) -> PipelineModel:
    """Scale and assemble; an estimator that reads its input ``repeated``ly gets it stored and persisted."""
    if repeated:
        train = busy_partitions(cut_lineage(train.select(*features, label)))
    vector = VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features")
    prepare = PipelineModel([scaler_stage(train, features), vector])
    ready = prepare.transform(train).select("features", label)
    if not repeated:
        return PipelineModel([*prepare.stages, estimator.fit(ready)])
    ready = ready.persist()
    try:
        fitted = estimator.fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel([*prepare.stages, fitted])


def fit_linear_regression(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Ordinary least squares from one pass over the normal equations."""
    ols = LinearRegression(labelCol=label, solver="normal", regParam=0.0)
    return _fit(train, features, label, ols, repeated=False)


def fit_logistic_regression(
    train: DataFrame, features: Sequence[str], label: str, *, c: float = 1.0, max_iter: int = 1000
) -> PipelineModel:
    """L2 logistic regression; ``c`` is the inverse penalty of a summed loss."""
    n = train.count()
    return _fit(
        train,
        features,
        label,
        LogisticRegression(
            labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter
        ),
    )


def fit_random_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    task: str = "regression",
    trees: int = 200,
    depth: int = 15,
    min_leaf: int = 2,
    seed: int = defaults.SEED,
) -> RandomForest | PipelineModel:
    """Bagged trees, see ``random_trees``: all features per split for regression, a square root of them otherwise.

    Classes other than 0 and 1 are left to MLlib's forest.
    """
    size = dict(trees=trees, depth=depth, min_leaf=min_leaf, seed=seed)
    if task == "regression" or train.filter(~F.col(label).cast("double").isin(0.0, 1.0)).isEmpty():
        return fit_bagged_trees(train, features, label, task=task, **size)
    common = dict(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)
    return _fit(train, features, label, RandomForestClassifier(featureSubsetStrategy="sqrt", **common))


def fit_random_threshold_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    task: str = "regression",
    trees: int = 300,
    depth: int = 16,
    min_leaf: int = 2,
    seed: int = defaults.SEED,
) -> RandomForest:
    """Trees without bootstrap whose nodes each draw one cut per feature, see ``random_trees``."""
    return fit_random_trees(train, features, label, task=task, trees=trees, depth=depth, min_leaf=min_leaf, seed=seed)


def fit_gradient_boosting(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    task: str = "regression",
    depth: int = 8,
    leaves: int = 31,
    rate: float = 0.08,
    iterations: int = 300,
    min_leaf: int = 25,
) -> BoostedTrees:
    """Leaf-wise trees over histograms of gradients, see ``boosting``."""
    return fit_boosted_trees(
        train, features, label, task=task, depth=depth, leaves=leaves, rate=rate, iterations=iterations, min_leaf=min_leaf
    )


def predict(model, df: DataFrame) -> DataFrame:
    """Input columns plus ``prediction`` and, for classifiers, the class-1 ``score``."""
    out = model.transform(df)
    if "probability" in out.columns and isinstance(out.schema["probability"].dataType, VectorUDT):
        out = out.withColumn("score", vector_to_array("probability")[1])
    kept = [c for c in ("score", "prediction") if c in out.columns]
    return out.select(*df.columns, *kept)
