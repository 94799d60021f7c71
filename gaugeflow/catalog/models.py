"""Estimators scored on the later part of the data, with the configured settings where nothing else is said."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.aggregates import DIST2
from gaugeflow.catalog.ordered_rows import ORDER, features_of
from gaugeflow.catalog.registry import DIMS, MEANS_SQL, VECTORS_SQL, query, rounded
from gaugeflow.functions import scalar
from gaugeflow.operators import (
    clustering,
    density,
    evaluation,
    features,
    neural,
    scaling,
    supervised,
)
from gaugeflow.session import cut_lineage, scratch_path
from gaugeflow.sources import tables

LINE = ["l_quantity", "l_discount", "l_tax", "month"]
SERIES_FEATURES = ["Hour_sin", "Hour_cos", "DayOfWeek", "v_lag_1h", "v_lag_3h", "v_lag_6h", "v_roll_mean_3h", "v_roll_mean_6h"]
VCOLS = [f"e{i}" for i in range(DIMS)]


def _lines(t):
    """Line items split by ship date: price as target, high price as flag."""
    df = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        scalar.month_of("l_shipdate").alias("month"), scalar.exceeds("l_extendedprice", 45_000).alias("flag"),
    )
    split = features.chronological_split(df, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return split.filter("split = 'train'"), split.filter("split = 'test'")


LINES_SQL = """k AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, month(l_shipdate)::DOUBLE AS month,
  l_extendedprice AS y, CAST(l_extendedprice > 45000 AS INT) AS flag,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn, count(*) OVER () AS n FROM lineitem),
train AS (SELECT * FROM k WHERE rn <= floor(n * 0.7::DOUBLE)), test AS (SELECT * FROM k WHERE rn > floor(n * 0.85::DOUBLE))"""
# The label that estimators fit follows from the features, so that SQL can say how good a sound fit is:
# two decimals of r2 or of the area under the curve are 1, where the training mean has 0 and a half.
SIGNAL_SQL = """l_quantity * (1 - l_discount) * 1000 + 300 * month(l_shipdate) + 20000 * l_tax"""
FIT_SQL = f"""k AS (SELECT l_orderkey, l_linenumber, l_returnflag, {SIGNAL_SQL} AS y, CAST({SIGNAL_SQL} > 28000 AS INT) AS flag,
  row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn, count(*) OVER () AS n FROM lineitem),
train AS (SELECT * FROM k WHERE rn <= floor(n * 0.7::DOUBLE)), test AS (SELECT * FROM k WHERE rn > floor(n * 0.85::DOUBLE))"""
REGRESSION_SQL = f"""WITH {FIT_SQL} SELECT count(*) AS n, round(avg(y), 4) AS label_mean,
  round(sqrt(avg((y - m) ** 2)), 4) AS baseline_rmse, 1::DOUBLE AS r2, true AS tenth_of_baseline
  FROM test, (SELECT avg(y) AS m FROM train)"""
CLASSIFICATION_SQL = f"""WITH {FIT_SQL} SELECT count(*) AS n, sum(flag)::BIGINT AS positives,
  round(avg(-ln(CASE WHEN flag = 1 THEN m ELSE 1 - m END)), 6) AS baseline_log_loss, 1::DOUBLE AS roc_auc, true AS tenth_of_baseline
  FROM test, (SELECT avg(flag) AS m FROM train)"""


def _labelled(t):
    """Line items split by ship date, with a label that follows from the features."""
    amount = F.col("l_quantity") * (1 - F.col("l_discount")) * 1000
    signal = amount + 300 * scalar.month_of("l_shipdate") + 20000 * F.col("l_tax")
    df = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        scalar.month_of("l_shipdate").alias("month"), signal.alias("y"),
    )
    df = df.withColumns(
        {"flag": scalar.exceeds("y", 28_000), "returned": (F.col("l_returnflag") == "R").cast("double")}
    )
    split = features.chronological_split(df, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return tuple(cut_lineage(split.filter(F.col("split") == name)) for name in ("train", "test"))


def _regression(t, fit, **size):
    train, test = _labelled(t)
    scored = supervised.predict(fit(train, LINE, "y", **size), test)
    m = train.agg(F.avg("y")).scalar()
    scored = scored.select("y", "prediction", ((F.col("y") - m) * (F.col("y") - m)).alias("sq"))
    base = scored.agg(F.count("*").alias("n"), F.avg("y").alias("label_mean"), F.sqrt(F.avg("sq")).alias("baseline_rmse"))
    found = evaluation.regression_metrics(scored, "y", "prediction").select("rmse", F.round("r2", 2).alias("r2"))
    out = base.join(F.broadcast(found)).withColumn("tenth_of_baseline", F.col("rmse") <= 0.1 * F.col("baseline_rmse"))
    return rounded(out.drop("rmse"), "label_mean", "baseline_rmse", digits=4)


def _classification(t, fit, **size):
    train, test = _labelled(t)
    scored = cut_lineage(supervised.predict(fit(train, LINE, "flag", **size), test).select("flag", "score", "prediction"))
    prior = train.agg(F.avg("flag")).scalar()
    loss = -F.ln(F.when(F.col("flag") == 1, prior).otherwise(1 - prior))
    base = scored.select("flag", loss.alias("l")).agg(
        F.count("*").alias("n"), F.sum("flag").alias("positives"), F.avg("l").alias("baseline_log_loss")
    )
    found = evaluation.classification_metrics(scored, "flag", "prediction", "score")
    found = found.select("log_loss", F.round("roc_auc", 2).alias("roc_auc"))
    out = base.join(F.broadcast(found)).withColumn("tenth_of_baseline", F.col("log_loss") <= 0.1 * F.col("baseline_log_loss"))
    return rounded(out.drop("log_loss"), "baseline_log_loss")


CLASSES = dict(task="classification")


@query("fit_random_forest", REGRESSION_SQL)
def _(t):
    # set when the configured 200 trees of depth 15 took MLlib eight minutes at sf0.01
    return _regression(t, supervised.fit_random_forest, trees=20, depth=12)


@query("fit_random_forest_classifier", CLASSIFICATION_SQL)
def _(t):
    return _classification(t, supervised.fit_random_forest, **CLASSES)


@query("fit_random_threshold_forest", REGRESSION_SQL)
def _(t):
    return _regression(t, supervised.fit_random_threshold_forest)


@query("fit_random_threshold_forest_classifier", CLASSIFICATION_SQL)
def _(t):
    return _classification(t, supervised.fit_random_threshold_forest, **CLASSES)


@query("fit_gradient_boosting", REGRESSION_SQL)
def _(t):
    return _regression(t, supervised.fit_gradient_boosting)


@query("fit_gradient_boosting_classifier", CLASSIFICATION_SQL)
def _(t):
    return _classification(t, supervised.fit_gradient_boosting, **CLASSES)


@query("fit_logistic_regression", CLASSIFICATION_SQL)
def _(t):
    return _classification(t, supervised.fit_logistic_regression)


# With one feature of two values every tree parts the two, so scores have closed forms: the means of both sides, and
# for boosting what 20 rounds at rate 0.08 leave between the mean of all and theirs.
@query(
    "predict",
    f"WITH {FIT_SQL}, m AS (SELECT l_returnflag = 'R' AS r, avg(flag) AS score FROM train GROUP BY ALL) "
    "SELECT l_orderkey, l_linenumber, round(score, 6) AS score, (score > 0.5)::INT::DOUBLE AS prediction "
    "FROM test JOIN m ON (l_returnflag = 'R') = r",
)
def _(t):
    train, test = _labelled(t)
    model = supervised.fit_random_threshold_forest(train, ["returned"], "flag", **CLASSES)
    return rounded(supervised.predict(model, test).select("l_orderkey", "l_linenumber", "score", "prediction"), "score")


@query(
    "predict_boosted",
    f"WITH {FIT_SQL}, m AS (SELECT l_returnflag = 'R' AS r, avg(y) AS own FROM train GROUP BY ALL) "
    "SELECT l_orderkey, l_linenumber, round(own + (m - own) * power(1 - 0.08, 20), 3) AS prediction "
    "FROM test JOIN m ON (l_returnflag = 'R') = r, (SELECT avg(y) AS m FROM train)",
)
def _(t):
    train, test = _labelled(t)
    model = supervised.fit_gradient_boosting(train, ["returned"], "y", iterations=20)
    return rounded(supervised.predict(model, test).select("l_orderkey", "l_linenumber", "prediction"), "prediction", digits=3)


# Embeddings moved apart by their label, so that the right groups are known.
GROUPS_SQL = "SELECT vec_id, min(vec_id) OVER (PARTITION BY label % 4) AS cluster FROM embeddings"


def _vectors(t):
    shift = 50 * (F.col("label") % 4)
    return t.vectors().withColumns({c: F.col(c) + shift for c in VCOLS})


def _by_least_member(model, df):
    """Clusters named by their least member."""
    found = supervised.predict(model, df).select("vec_id", "prediction")
    least = found.groupBy("prediction").agg(F.min("vec_id").alias("cluster"))
    return found.join(least, "prediction").select("vec_id", "cluster")


@query("fit_kmeans", GROUPS_SQL)
def _(t):
    df = _vectors(t)
    return _by_least_member(clustering.fit_kmeans(df, VCOLS), df)


@query("fit_gmm", GROUPS_SQL)
def _(t):
    df = _vectors(t)
    return _by_least_member(clustering.fit_gmm(df, VCOLS), df)


@query("fit_hierarchical", GROUPS_SQL)
def _(t):
    df = _vectors(t)
    return _by_least_member(clustering.fit_hierarchical(df, VCOLS), df)


SCALED_SQL = (
    VECTORS_SQL.replace("v AS (", "raw AS MATERIALIZED (", 1)
    + ", v AS MATERIALIZED (SELECT vec_id, label, "
    + ", ".join(f"(e{i} - avg(e{i}) OVER ()) / stddev_pop(e{i}) OVER () AS e{i}" for i in range(DIMS))
    + " FROM raw)"
)


@query(
    "cluster_metrics",
    f"WITH {SCALED_SQL}, d AS (SELECT a.vec_id, a.label AS c, b.label AS o, sum({DIST2}) AS s, count(*) AS n FROM v a, v b GROUP BY ALL), "
    "k AS (SELECT vec_id, max(CASE WHEN c = o AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM d GROUP BY vec_id), "
    f"m AS (SELECT label, {MEANS_SQL} FROM v GROUP BY label), "
    f"sp AS (SELECT a.label, avg(sqrt({DIST2})) AS s FROM v a JOIN m b USING (label) GROUP BY a.label), "
    f"w AS (SELECT a.label, max((sa.s + sb.s) / sqrt({DIST2})) AS worst FROM m a JOIN m b ON a.label <> b.label "
    "JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label GROUP BY a.label) "
    "SELECT (SELECT count(DISTINCT label) FROM v) AS n_clusters, 0::DOUBLE AS noise_ratio, "
    "(SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / greatest(a, b), 0) END), 5) FROM k) AS silhouette_score, "
    "(SELECT round(avg(worst), 5) FROM w) AS davies_bouldin_index",
)
def _(t):
    return rounded(
        clustering.cluster_metrics(t.vectors(), "label", VCOLS, "vec_id"),
        "silhouette_score", "davies_bouldin_index", "noise_ratio", digits=5,
    )


@query("project_2d")
def _(t):
    return clustering.project_2d(t.vectors(), VCOLS, ["vec_id"])


EPS, MIN_SAMPLES = 1.19, 5
SHIFTED_SQL = VECTORS_SQL.replace("::DOUBLE AS e", "::DOUBLE + 50 * (label % 4) AS e").replace("v AS (", "v AS MATERIALIZED (", 1)
DBSCAN_SQL = f"""WITH RECURSIVE {SHIFTED_SQL},
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE sqrt({DIST2}) <= {EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.id JOIN core c ON c.id = n.b),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
numbered AS (SELECT id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS label FROM comp),
edge AS (SELECT n.a AS id, min(label) AS label FROM near n JOIN numbered m ON m.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT v.vec_id, m.id IS NOT NULL AS is_core, coalesce(m.label, e.label, -1) AS label
FROM v LEFT JOIN numbered m ON m.id = v.vec_id LEFT JOIN edge e ON e.id = v.vec_id"""


@query("dbscan", DBSCAN_SQL)
def _(t):
    out = density.dbscan(_vectors(t), VCOLS, "vec_id", eps=EPS, min_samples=MIN_SAMPLES)
    return out.select("vec_id", "is_core", "label")


def _series_split(t):
    folder = scratch_path(t.spark, "stages")
    tables.write_stage_tables({"features": features_of(t)}, folder)
    split = features.chronological_split(tables.read_stage_tables(t.spark, folder, ["features"])["features"], ORDER)
    return tuple(split.filter(F.col("split") == name) for name in ("train", "val", "test"))


@query("fit_mlp")
def _(t):
    train, val, test = _series_split(t)
    model = neural.fit_mlp(train, val, SERIES_FEATURES, "v")
    return rounded(evaluation.regression_metrics(model.transform(test), "v", "prediction"), "rmse", "mae", "r2")


@query("fit_mlp_classifier")
def _(t):
    train, val, test = _series_split(t)
    model = neural.fit_mlp(
        train, val, SERIES_FEATURES, "High_Pollution", task="classification", hidden=(128, 64, 32), activation="tanh"
    )
    scored = model.transform(test)
    return rounded(
        evaluation.classification_metrics(scored, "High_Pollution", "prediction", "score"), "f1", "roc_auc", "pr_auc", "log_loss"
    )


@query("training_history")
def _(t):
    train, val, _ = _series_split(t)
    model = neural.fit_mlp(train, val, SERIES_FEATURES, "v")
    return rounded(model.history_frame(t.spark), "train_loss", "val_loss")


@query(
    "standardize_train_only",
    f"WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) + 0.0 AS {c}" for c in LINE)
    + " FROM test",
)
def _(t):
    train, test = _lines(t)
    out = scaling.standardize(test.select("l_orderkey", "l_linenumber", *LINE), LINE, fit_on=train)
    return rounded(out, *LINE)
