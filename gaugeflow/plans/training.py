"""The whole run: raw series to stage tables, statistics, fitted models and comparison tables.

Every stage is written below one shared folder and read back, so a lost executor never
repeats an earlier stage and the evaluation of all models is one grouped query over the
stored predictions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.operators import (
    cleaning,
    clustering,
    decision,
    density,
    describe,
    diagnostics,
    evaluation,
    features,
    hypothesis,
    neural,
    supervised,
)
from gaugeflow.plans import defaults
from gaugeflow.plans.ordered import order_rows, with_rank
from gaugeflow.sources import tables


@dataclass(frozen=True)
class Sizes:
    """Estimator settings; the defaults are the configured ones."""

    forest: Mapping = field(default_factory=lambda: dict(trees=200, depth=15, min_leaf=2))
    random_threshold: Mapping = field(default_factory=lambda: dict(trees=300, depth=16, min_leaf=2))
    boosting: Mapping = field(default_factory=lambda: dict(depth=8, rate=0.08, iterations=300, min_leaf=25))
    kmeans: Mapping = field(default_factory=lambda: dict(k=4, restarts=10, max_iter=300))
    gmm: Mapping = field(default_factory=lambda: dict(k=4, restarts=5))
    hierarchical: Mapping = field(default_factory=lambda: dict(k=4))
    dbscan: Mapping = field(default_factory=lambda: dict(eps=0.85, min_samples=18))
    mlp: Mapping = field(default_factory=lambda: defaults.MLP_PROFILES)


class Run:
    """One run over a raw table; each step returns DataFrames and leaves its tables behind."""

    def __init__(
        self,
        folder: str,
        *,
        sizes: Sizes | None = None,
        order_cols: Sequence[str] = (defaults.TIME,),
        partition_cols: Sequence[str] = (),
        threshold: float = defaults.REGULATORY_THRESHOLD,
        block_rows: int | None = None,
        squared_silhouette: bool = True,
    ):
        self.folder, self.sizes = folder, sizes or Sizes()
        self.order, self.series = list(order_cols), list(partition_cols)
        self.threshold, self.block_rows, self.squared = threshold, block_rows, squared_silhouette

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        tables.write_stage_tables({name: df}, self.folder)
        return tables.read_stage_tables(df.sparkSession, self.folder, [name])[name]

    def prepare(self, raw: DataFrame) -> dict[str, DataFrame]:
        """Cleaned rows, features, and the chronological train, val and test tables.

        The parsed input is stored first: later passes read single columns of it instead
        of the text again.
        """
        common = dict(order_cols=self.order, partition_cols=self.series, block_rows=self.block_rows)
        parsed = self._store("raw", cleaning.drop_missing_key(cleaning.parse_datetime(raw)))
        out = {"cleaned": self._store("cleaned", cleaning.clean_series(parsed, **common))}
        feat = features.feature_frame(out["cleaned"], threshold=self.threshold, **common)
        out["features"] = self._store("features", feat)
        split = features.chronological_split(out["features"], [*self.order, *self.series], block_rows=self.block_rows)
        for name in ("train", "val", "test"):
            out[name] = self._store(name, split.filter(F.col("split") == name).drop("split"))
        return out

    def feature_columns(self, train: DataFrame) -> list[str]:
        skip = (defaults.TIME, defaults.TARGET, defaults.FLAG, *self.order, *self.series)
        return features.feature_columns(train, skip)

    def statistics(self, feat: DataFrame) -> dict[str, DataFrame]:
        cols = self.feature_columns(feat)
        core = [c for c in (*defaults.SENSOR_COLUMNS, *defaults.GROUND_TRUTH_COLUMNS, *defaults.ENVIRONMENT_COLUMNS) if c in feat.columns]
        out = {
            "column_statistics": describe.describe_columns(feat, cols),
            "correlation_matrix": describe.correlation_matrix(feat, cols),
            "correlation_heatmap": describe.correlation_lower_triangle(feat, core),
            "seasonal_anova": hypothesis.anova_oneway(feat, defaults.TARGET, "Season"),
            "season_means": describe.group_mean(feat, defaults.TARGET, "Season"),
        }
        if "Temperature" in feat.columns:
            out["two_sample_ttest"] = hypothesis.welch_ttest(feat, defaults.TARGET, "Temperature")
        if "Rel_Humidity" in feat.columns:
            out["chi_square"] = hypothesis.humidity_independence(feat)
            levels = scalar.bucketize("Rel_Humidity", defaults.HUMIDITY_EDGES, defaults.HUMIDITY_LABELS)
            out["contingency"] = describe.crosstab(feat.withColumn("Humidity", levels), "Humidity", defaults.FLAG)
        return {name: self._store(name, df) for name, df in out.items()}

    def regress(self, stages: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Four regressors and the perceptron profiles, scored on the test rows."""
        train, cols, y = stages["train"], self.feature_columns(stages["train"]), defaults.TARGET
        fits = {
            "linear_regression": lambda: supervised.fit_linear_regression(train, cols, y),
            "random_forest_reg": lambda: supervised.fit_random_forest(train, cols, y, **self.sizes.forest),
            "extra_trees_reg": lambda: supervised.fit_random_threshold_forest(train, cols, y, **self.sizes.random_threshold),
            "hist_gradient_boosting_reg": lambda: supervised.fit_gradient_boosting(train, cols, y, **self.sizes.boosting),
        }
        scored = self._score_all(fits, stages, "regression", y)
        metrics = self._store("regression_metrics", evaluation.regression_metrics(scored, "y", "prediction", ["model"]))
        linear = evaluation.residuals(scored.filter("model = 'linear_regression'"), "y", "prediction")
        kw = dict(block_rows=self.block_rows)
        diag = diagnostics.residual_diagnostics(linear, "residual", self.order, self.series, **kw)
        return {
            "regression_metrics": metrics,
            "residual_diagnostics": self._store("residual_diagnostics", diag),
            "qq_points": self._store("qq_points", diagnostics.qq_points(linear, "residual", [*self.order, *self.series], **kw)),
            "vif": self._store("vif", diagnostics.vif(train, cols)),
        }

    def classify(self, stages: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Four classifiers and the perceptron profiles, with curves and thresholds."""
        train, cols, y = stages["train"], self.feature_columns(stages["train"]), defaults.FLAG
        as_class = dict(task="classification")
        fits = {
            "logistic_regression": lambda: supervised.fit_logistic_regression(train, cols, y),
            "random_forest_clf": lambda: supervised.fit_random_forest(train, cols, y, **self.sizes.forest, **as_class),
            "extra_trees_clf": lambda: supervised.fit_random_threshold_forest(train, cols, y, **self.sizes.random_threshold, **as_class),
            "hist_gradient_boosting_clf": lambda: supervised.fit_gradient_boosting(train, cols, y, **self.sizes.boosting, **as_class),
        }
        scored = self._score_all(fits, stages, "classification", y)
        by, kw = ["model"], dict(block_rows=self.block_rows)
        swept = self._store("threshold_sweep", evaluation.threshold_sweep(scored, "y", "score", by))
        out = {
            "classification_metrics": evaluation.classification_metrics(scored, "y", "prediction", "score", by, **kw),
            "roc_curves": evaluation.roc_curve(scored, "y", "score", by, **kw),
            "pr_curves": evaluation.pr_curve(scored, "y", "score", by, **kw),
            "calibration": evaluation.calibration_bins(scored, "y", "score", by),
            "best_thresholds": evaluation.best_threshold(swept, by),
        }
        return {name: self._store(name, df) for name, df in out.items()} | {"threshold_sweep": swept}

    def _score_all(self, fits: Mapping, stages: Mapping[str, DataFrame], task: str, label: str) -> DataFrame:
        """Fit, save and score every model; one stored table of (model, order, y, score, prediction)."""
        test, cols = stages["test"], self.feature_columns(stages["train"])
        rows = None
        for name, fit in fits.items():
            model = fit()
            tables.save_model(model, f"{self.folder}/models/{name}")
            rows = self._add(rows, supervised.predict(model, test), name, label)
        for profile, config in self.sizes.mlp.items():
            name = f"{profile}_{task}"
            model = neural.fit_mlp(stages["train"], stages["val"], cols, label, task=task, **config)
            tables.save_model(model, f"{self.folder}/models/{name}")
            self._store(f"history_{name}", model.history_frame(test.sparkSession))
            rows = self._add(rows, model.transform(test), name, label)
        return self._store(f"predictions_{task}", rows)

    def _add(self, rows: DataFrame | None, scored: DataFrame, name: str, label: str) -> DataFrame:
        kept = [c for c in ("score", "prediction") if c in scored.columns]
        one = scored.select(F.lit(name).alias("model"), *self.order, *self.series, F.col(label).alias("y"), *kept)
        return one if rows is None else rows.unionByName(one)

    def cluster(self, feat: DataFrame) -> dict[str, DataFrame]:
        """Four clusterings of the sensor and environment columns over all rows."""
        cols = [c for c in (*defaults.SENSOR_COLUMNS, *defaults.ENVIRONMENT_COLUMNS) if c in feat.columns]
        ordered = order_rows(feat, [*self.order, *self.series], block_rows=self.block_rows)
        keyed = self._store("clustered_rows", with_rank(ordered, "row_id").result())
        fitted = {
            "kmeans": clustering.fit_kmeans(feat, cols, **self.sizes.kmeans),
            "gmm": clustering.fit_gmm(feat, cols, **self.sizes.gmm),
            "agglomerative": clustering.fit_hierarchical(feat, cols, **self.sizes.hierarchical),
        }
        labelled = {}
        for name, model in fitted.items():
            tables.save_model(model, f"{self.folder}/models/{name}")
            labelled[name] = supervised.predict(model, keyed).withColumnRenamed("prediction", "cluster")
        dense = density.dbscan(keyed, cols, "row_id", scale=True, **self.sizes.dbscan)
        labelled["dbscan"] = keyed.join(dense.select("row_id", F.col("label").alias("cluster")), "row_id")
        metrics = None
        for name, df in labelled.items():
            df = self._store(f"clusters_{name}", df)
            one = clustering.cluster_metrics(df, "cluster", cols, "row_id", squared=self.squared).withColumn("model", F.lit(name))
            metrics = one if metrics is None else metrics.unionByName(one)
            labelled[name] = df
        profile = describe.cluster_profile(labelled["kmeans"], "cluster", [*cols, defaults.TARGET])
        view = clustering.project_2d(labelled["kmeans"], cols, ["row_id", "cluster"])
        return {
            "clustering_metrics": self._store("clustering_metrics", metrics),
            "cluster_summary": self._store("cluster_summary", profile),
            "cluster_view": self._store("cluster_view", view),
        }

    def everything(self, raw: DataFrame) -> dict[str, DataFrame]:
        stages = self.prepare(raw)
        out = stages | self.statistics(stages["features"]) | self.regress(stages)
        out |= self.classify(stages) | self.cluster(stages["features"])
        flat = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [out[f"{kind}_metrics"] for kind in ("regression", "classification", "clustering")],
        )
        out["headline_metrics"] = self._store("headline_metrics", decision.headline_metrics(flat, decision.HEADLINE))
        compared = decision.model_comparison(out["regression_metrics"], out["classification_metrics"])
        out["model_comparison"] = self._store("model_comparison", compared)
        out["leaderboard_regression"] = self._store(
            "leaderboard_regression", decision.leaderboard(out["regression_metrics"], "regression")
        )
        out["leaderboard"] = self._store("leaderboard", decision.leaderboard(out["classification_metrics"], "classification"))
        return out
