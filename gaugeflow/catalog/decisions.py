"""Decision thresholds, metric documents and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.aggregates import AREAS, COUNTS, LOSS
from gaugeflow.catalog.registry import DIMS, FITS_SQL, LINE_SCORES_SQL, ORACLES, SCORES_SQL, query, rounded
from gaugeflow.functions import scalar
from gaugeflow.operators import clustering, decision, evaluation

VCOLS = [f"e{i}" for i in range(DIMS)]

SWEEP = f"""WITH {LINE_SCORES_SQL},
g AS (SELECT i, CASE WHEN i = 99 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE + i * ((0.99::DOUBLE - 0.01::DOUBLE) / 99) END AS t FROM range(100) r(i)),
c AS (SELECT model, t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp,
  count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 0 AND p < t) AS tn FROM sc, g GROUP BY model, t),
w AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp * 10 - fp * 3 - fn * 15 + tn * 0)::DOUBLE AS ev FROM c)"""


@query("threshold_sweep", f"{SWEEP} SELECT model, round(t, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS f1, ev AS expected_value FROM w")
def _(t):
    return rounded(evaluation.threshold_sweep(t.line_scores(), "y", "p", ["model"]), "threshold", "f1", "expected_value")


@query(
    "best_threshold",
    f"{SWEEP} SELECT model, round(first(t ORDER BY f1 DESC, t), 6) AS best_f1_threshold, round(first(t ORDER BY ev DESC, t), 6) AS best_ev_threshold FROM w GROUP BY model",
)
def _(t):
    swept = evaluation.threshold_sweep(t.line_scores(), "y", "p", ["model"])
    return rounded(evaluation.best_threshold(swept, ["model"]), "best_f1_threshold", "best_ev_threshold")


@query("argmax_first", "SELECT l_returnflag, first(l_orderkey ORDER BY l_quantity DESC, l_orderkey) AS best FROM lineitem GROUP BY l_returnflag")
def _(t):
    return evaluation.argmax_first(t("lineitem"), "l_quantity", "l_orderkey", ["l_returnflag"])


def _regression(t):
    named = t.fits().withColumn("model", F.concat(F.lit("flag_"), F.lower("model"), F.lit("_regression")))
    return evaluation.regression_metrics(named, "y", "pred", ["model"])


def _classification(t):
    named = t.scores().withColumns(
        {"model": F.concat("model", F.lit("_classification")), "c": scalar.classify_at("p", 0.5)}
    )
    return evaluation.classification_metrics(named, "y", "c", "p", ["model"])


def documents(t):
    """One JSON metric document per model, of both tasks."""
    reg = _regression(t).select(decision.metric_documents("model", ["rmse", "mae", "r2"]).alias("doc"))
    keys = ["precision", "recall", "f1", "roc_auc", "pr_auc", "log_loss"]
    return reg.union(_classification(t).select(decision.metric_documents("model", keys).alias("doc")))


REG_SQL = f"""{FITS_SQL}, reg AS (SELECT 'flag_' || lower(model) || '_regression' AS model, sqrt(avg((y - pred) ** 2)) AS rmse,
  avg(abs(y - pred)) AS mae, 1 - avg((y - pred) ** 2) / var_pop(y) AS r2 FROM f GROUP BY 1)"""
CLF_SQL = f"""{SCORES_SQL}, {AREAS}, m AS (SELECT model, {COUNTS}, {LOSS} AS log_loss FROM sc GROUP BY model),
clf AS (SELECT model || '_classification' AS model, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, roc_auc, pr_auc, log_loss FROM m JOIN areas USING (model))"""
FLAT = ("rmse", "mae", "r2", "roc_auc", "pr_auc", "f1", "precision", "recall", "log_loss")
FLAT_SQL = (
    "flat AS (SELECT model, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS pr_auc, "
    "NULL::DOUBLE AS f1, NULL::DOUBLE AS \"precision\", NULL::DOUBLE AS recall, NULL::DOUBLE AS log_loss FROM reg UNION ALL "
    "SELECT model, NULL, NULL, NULL, roc_auc, pr_auc, round(f1, 6), round(\"precision\", 6), round(recall, 6), round(log_loss, 6) FROM clf)"
)


def _flat(t):
    flat = decision.flatten_metrics(documents(t), "doc").select("model", *FLAT)
    return rounded(rounded(flat, "rmse", "mae", digits=4), *FLAT[2:])


@query("flatten_metrics", f"WITH {REG_SQL}, {CLF_SQL}, {FLAT_SQL} SELECT * FROM flat")
def _(t):
    return _flat(t)


@query("select_by_metric_keys", f"WITH {REG_SQL}, {CLF_SQL}, {FLAT_SQL} SELECT * FROM flat WHERE rmse IS NOT NULL")
def _(t):
    return decision.select_by_suffix(decision.select_by_metric_keys(_flat(t), "regression"), "regression")


@query(
    "headline_metrics",
    f"WITH {REG_SQL}, {CLF_SQL}, {FLAT_SQL} SELECT max(r2) FILTER (model = 'flag_a_regression') AS linear_r2, "
    "max(roc_auc) FILTER (model = 'en_classification') AS logistic_auc, max(r2) FILTER (model = 'flag_n_regression') AS mlp_r2, "
    f"(SELECT silhouette_score FROM ({ORACLES['silhouette_sq']})) AS kmeans_silhouette FROM flat",
)
def _(t):
    # models of the given tables stand for those of a run
    shape = rounded(clustering.silhouette_sq(t.vectors(), "label", VCOLS), "silhouette_score")
    flat = _flat(t).unionByName(shape.withColumn("model", F.lit("kmeans")), allowMissingColumns=True)
    stands = {"linear_regression": "flag_a_regression", "logistic_regression": "en_classification", "mlp_regression": "flag_n_regression"}
    wanted = {name: (stands.get(model, model), metric) for name, (model, metric) in decision.HEADLINE.items()}
    return decision.headline_metrics(flat, wanted)


def _title(column):
    words = f"regexp_extract_all(replace({column}, '_', ' '), '([A-Za-z]+|[^A-Za-z]+)')"
    return f"list_aggregate(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')"


@query(
    "model_comparison",
    f"WITH {REG_SQL}, {CLF_SQL} SELECT {_title('model')} AS model, 'Regression' AS task, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, "
    "NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS f1, NULL::DOUBLE AS \"precision\", NULL::DOUBLE AS recall FROM reg UNION ALL "
    f"SELECT {_title('model')}, 'Classification', NULL, NULL, NULL, roc_auc, round(f1, 6), round(\"precision\", 6), round(recall, 6) FROM clf",
)
def _(t):
    out = decision.model_comparison(_regression(t), _classification(t))
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2", "roc_auc", "f1", "precision", "recall")


@query(
    "leaderboard",
    f"WITH {REG_SQL}, {CLF_SQL} SELECT 'regression' AS task, model, round(rmse, 4) AS metric, CAST(row_number() OVER (ORDER BY rmse, model) AS INT) AS place FROM reg "
    "UNION ALL SELECT 'classification', model, round(f1, 6), CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INT) FROM clf",
)
def _(t):
    reg = decision.leaderboard(_regression(t), "regression")
    clf = decision.leaderboard(_classification(t), "classification")
    reg = rounded(reg.select(F.lit("regression").alias("task"), "model", F.col("rmse").alias("metric"), "place"), "metric", digits=4)
    clf = rounded(clf.select(F.lit("classification").alias("task"), "model", F.col("f1").alias("metric"), "place"), "metric")
    return reg.unionByName(clf)
