"""Descriptive statistics, metrics and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.registry import (
    DIMS,
    FITS_SQL,
    LINE_SCORES_SQL,
    MEANS_SQL,
    SCORES_SQL,
    VECTORS_SQL,
    query,
    r,
    rounded,
)
from gaugeflow.functions import scalar
from gaugeflow.operators import clustering, describe, evaluation
from gaugeflow.plans import defaults

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(cols, table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(var_samp({c}), 2) AS variance, round(stddev_samp({c}), 4) AS std, "
        f"round(skewness({c}), 5) + 0.0 AS skewness, round(kurtosis({c}), 5) + 0.0 AS excess_kurtosis, min({c}) AS min, max({c}) AS max, "
        f"median({c}) AS median, count({c}) AS n FROM {table}"
        for c in cols
    )


@query("describe_columns", _describe_sql(LINE_COLS, "lineitem"))
def _(t):
    # the row limit is below the table size, so medians come from histogram passes
    out = describe.describe_columns(t("lineitem"), LINE_COLS)
    out = rounded(out, "mean", "std", digits=4).withColumn("variance", r("variance", 2))
    return rounded(out, "skewness", "excess_kurtosis", digits=5)


def _corr_sql(cols, table, lower):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM {table}"
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if not lower or i >= j
    )


@query("correlation_matrix", _corr_sql(LINE_COLS, "lineitem", False))
def _(t):
    return rounded(describe.correlation_matrix(t("lineitem"), LINE_COLS).select("a", "b", "r"), "r")


@query("correlation_lower_triangle", _corr_sql(LINE_COLS, "lineitem", True))
def _(t):
    return rounded(describe.correlation_lower_triangle(t("lineitem"), LINE_COLS).select("a", "b", "r"), "r")


@query("group_mean", "SELECT CAST((month(o_orderdate) % 12) // 3 AS INT) AS season, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(t):
    df = t("orders").withColumn("season", scalar.season_of("o_orderdate"))
    return rounded(describe.group_mean(df, "o_totalprice", "season"), "mean", digits=4)


BUCKETED = (
    "SELECT CASE WHEN value <= 30 THEN 'Low' WHEN value <= 60 THEN 'Medium' WHEN value <= 100 THEN 'High' END AS bucket, "
    "CAST(value > 90 AS INT) AS flag FROM events"
)


def bucketed(t):
    bucket = scalar.bucketize("value", defaults.HUMIDITY_EDGES, defaults.HUMIDITY_LABELS)
    return t("events").select(bucket.alias("bucket"), scalar.exceeds("value", 90).alias("flag"))


CROSSTAB_SQL = f"""b AS (SELECT * FROM ({BUCKETED}) WHERE bucket IS NOT NULL),
cells AS (SELECT rw.bucket AS "row", cl.flag AS "column", (SELECT count(*) FROM b WHERE b.bucket = rw.bucket AND b.flag = cl.flag) AS n
  FROM (SELECT DISTINCT bucket FROM b) rw, (SELECT DISTINCT flag FROM b) cl)"""


@query("crosstab", f"WITH {CROSSTAB_SQL} SELECT * FROM cells")
def _(t):
    return describe.crosstab(bucketed(t), "bucket", "flag")


@query("class_balance", "SELECT round(avg(CAST(value > 120 AS INT)), 6) AS positive_share FROM events")
def _(t):
    flagged = t("events").select(scalar.exceeds("value", defaults.REGULATORY_THRESHOLD).alias("flag"))
    return rounded(describe.class_balance(flagged, "flag"), "positive_share")


@query("residuals", f"WITH {FITS_SQL} SELECT l_orderkey, l_linenumber, pred AS fitted, round(y - pred, 4) + 0.0 AS residual FROM f")
def _(t):
    out = evaluation.residuals(t.fits(), "y", "pred")
    return out.select("l_orderkey", "l_linenumber", F.col("pred").alias("fitted"), r("residual", 4).alias("residual"))


@query(
    "regression_metrics",
    f"WITH {FITS_SQL} SELECT model, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae, "
    "round(1 - avg((y - pred) ** 2) / var_pop(y), 6) AS r2 FROM f GROUP BY model",
)
def _(t):
    out = evaluation.regression_metrics(t.fits(), "y", "pred", ["model"])
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2")


COUNTS = (
    "count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, "
    "count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp"
)


def _classified(t):
    return t.scores().withColumn("c", scalar.classify_at("p", 0.5))


@query("confusion_counts", f"WITH {SCORES_SQL} SELECT model, {COUNTS} FROM sc GROUP BY model")
def _(t):
    return evaluation.confusion_counts(_classified(t), "y", "c", ["model"])


AREAS = """g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY model, p),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn
  FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
areas AS (SELECT model, round(sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6) AS roc_auc,
  CASE WHEN sum(pos) > 0 THEN round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) ELSE 0 END AS pr_auc FROM k GROUP BY model)"""
LOSS = "avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)"


@query(
    "classification_metrics",
    f"WITH {SCORES_SQL}, {AREAS}, m AS (SELECT model, {COUNTS}, round({LOSS}, 6) AS log_loss FROM sc GROUP BY model) "
    "SELECT m.*, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, "
    "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, roc_auc, pr_auc FROM m JOIN areas USING (model)",
)
def _(t):
    out = evaluation.classification_metrics(_classified(t), "y", "c", "p", ["model"])
    return rounded(out, "log_loss", "precision", "recall", "f1", "roc_auc", "pr_auc")


@query("roc_auc", f"WITH {LINE_SCORES_SQL}, {AREAS} SELECT model, roc_auc FROM areas")
def _(t):
    return rounded(evaluation.roc_auc(t.line_scores(), "y", "p", ["model"]), "roc_auc")


@query("average_precision", f"WITH {LINE_SCORES_SQL}, {AREAS} SELECT model, pr_auc FROM areas")
def _(t):
    return rounded(evaluation.average_precision(t.line_scores(), "y", "p", ["model"]), "pr_auc")


@query(
    "roc_curve",
    f"WITH {SCORES_SQL}, {AREAS} SELECT model, round(p, 9) AS threshold, round(fp / nullif(nn, 0), 6) AS fpr, round(tp / nullif(np, 0), 6) AS tpr FROM k "
    "UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM sc",
)
def _(t):
    out = evaluation.roc_curve(t.scores(), "y", "p", ["model"])
    return rounded(out, "fpr", "tpr").withColumn("threshold", r("threshold", 9))


@query(
    "pr_curve",
    f"WITH {SCORES_SQL}, {AREAS} SELECT model, round(p, 9) AS threshold, round(tp / (tp + fp), 6) AS \"precision\", coalesce(round(tp / nullif(np, 0), 6), 1) AS recall FROM k "
    "UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM sc",
)
def _(t):
    out = evaluation.pr_curve(t.scores(), "y", "p", ["model"])
    return rounded(out, "precision", "recall").withColumn("threshold", r("threshold", 9))


@query("log_loss", f"WITH {LINE_SCORES_SQL} SELECT model, round({LOSS}, 6) AS log_loss FROM sc GROUP BY model")
def _(t):
    return rounded(evaluation.log_loss(t.line_scores(), "y", "p", ["model"]), "log_loss")


EDGES = " + ".join(f"CAST({i * 0.1!r}::DOUBLE < p AS INT)" for i in range(1, 10))


@query(
    "calibration_bins",
    f"WITH {LINE_SCORES_SQL} SELECT model, {EDGES} AS bin, round(avg(y), 6) AS fraction_positive, round(avg(p), 6) AS mean_predicted FROM sc GROUP BY model, bin",
)
def _(t):
    return rounded(
        evaluation.calibration_bins(t.line_scores(), "y", "p", ["model"]), "fraction_positive", "mean_predicted"
    )


@query(
    "cluster_profile",
    f"WITH {VECTORS_SQL}, m AS (SELECT label, {MEANS_SQL} FROM v GROUP BY label) SELECT label, "
    + ", ".join(f"round((e{i} - avg(e{i}) OVER ()) / stddev_samp(e{i}) OVER (), 6) + 0.0 AS e{i}" for i in range(DIMS))
    + " FROM m",
)
def _(t):
    cols = [f"e{i}" for i in range(DIMS)]
    return rounded(describe.cluster_profile(t.vectors(), "label", cols), *cols)


@query(
    "cluster_counts",
    "SELECT count(DISTINCT CASE WHEN label > 0 THEN label END) AS n_clusters, round(avg(CAST(label = 0 AS INT)), 6) AS noise_ratio FROM embeddings",
)
def _(t):
    labels = t("embeddings").select(F.when(F.col("label") > 0, F.col("label")).otherwise(F.lit(-1)).alias("c"))
    return rounded(describe.cluster_counts(labels, "c"), "noise_ratio")


VCOLS = [f"e{i}" for i in range(DIMS)]
DIST2 = " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(DIMS))


def _silhouette_sql(dist):
    return (
        f"WITH {VECTORS_SQL}, d AS (SELECT a.vec_id, a.label AS c, b.label AS o, sum({dist}) AS s, count(*) AS n FROM v a, v b GROUP BY ALL), "
        "k AS (SELECT vec_id, max(CASE WHEN c = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM d GROUP BY vec_id) "
        "SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette_score FROM k"
    )


@query("silhouette", _silhouette_sql(f"sqrt({DIST2})"))
def _(t):
    out = clustering.silhouette(t.vectors(), "label", VCOLS, "vec_id")
    return rounded(out, "silhouette_score")


@query("silhouette_sq", _silhouette_sql(DIST2))
def _(t):
    return rounded(clustering.silhouette_sq(t.vectors(), "label", VCOLS), "silhouette_score")


@query(
    "davies_bouldin",
    f"WITH {VECTORS_SQL}, m AS (SELECT label, {MEANS_SQL} FROM v GROUP BY label), "
    f"s AS (SELECT a.label, avg(sqrt({DIST2})) AS s FROM v a JOIN m b USING (label) GROUP BY a.label), "
    f"w AS (SELECT a.label, max((sa.s + sb.s) / sqrt({DIST2})) AS worst FROM m a JOIN m b ON a.label <> b.label "
    "JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label) SELECT round(avg(worst), 5) AS davies_bouldin_index FROM w",
)
def _(t):
    return rounded(clustering.davies_bouldin(t.vectors(), "label", VCOLS), "davies_bouldin_index", digits=5)
