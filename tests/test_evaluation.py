import numpy as np
import pytest

from gaugeflow.operators import decision, evaluation


def scored(spark, y, p, c=None):
    rows = [(int(a), float(b), int(d)) for a, b, d in zip(y, p, c or [x >= 0.5 for x in p])]
    return spark.createDataFrame(rows, "y int, p double, c int")


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.5), (2.0, 2.0, 2.5), (3.0, 3.0, 2.5), (4.0, 4.0, 3.5)], "y double, same double, near double")
    assert tuple(evaluation.regression_metrics(df, "y", "same").first()) == (0, 0, 1)
    r = evaluation.regression_metrics(df, "y", "near").first()
    assert (r["rmse"], r["mae"]) == (0.5, 0.5)


def test_perfect_and_all_negative(spark):
    r = evaluation.classification_metrics(scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8]), "y", "c", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["roc_auc"], r["pr_auc"]) == (1, 1, 1, 1, 1)
    r = evaluation.classification_metrics(scored(spark, [0, 1, 0, 1], [0, 0, 0, 0], [0] * 4), "y", "c").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0, 0, 0)


def test_one_class_only(spark):
    r = evaluation.classification_metrics(scored(spark, [0, 0], [0.1, 0.9]), "y", "c", "p").first()
    assert r["roc_auc"] is None and r["f1"] == 0 and r["pr_auc"] == 0


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 399)
    p = np.round(np.clip(0.3 * y + rng.random(399) * 0.7, 0, 1), 2)
    return y, p, scored(spark, y, p).repartition(3).cache()


def test_areas_match_pair_counting(noisy):
    y, p, df = noisy
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    auc = ((pos > neg) + 0.5 * (pos == neg)).mean()
    ap, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = (y[hit] == 1).sum() / y.sum(), (y[hit] == 1).mean()
        ap, prev = ap + (recall - prev) * precision, recall
    r = evaluation.curve_areas(df, "y", "p").first()
    assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)


def test_curves(spark, noisy):
    y, p, df = noisy
    roc = evaluation.roc_curve(df, "y", "p").toPandas().sort_values(["fpr", "tpr"])
    assert len(roc) == len(set(p)) + 1
    assert tuple(roc.iloc[0][["fpr", "tpr"]]) == (0, 0) and tuple(roc.iloc[-1][["fpr", "tpr"]]) == (1, 1)
    pr = evaluation.pr_curve(df, "y", "p").toPandas()
    end = pr[pr["threshold"].isna()]
    assert len(pr) == len(set(p)) + 1 and tuple(end.iloc[0][["precision", "recall"]]) == (1, 0)


def test_sweep_equals_direct_counts(noisy):
    y, p, df = noisy
    swept = evaluation.threshold_sweep(df, "y", "p").orderBy("threshold").collect()
    grid = np.linspace(0.01, 0.99, 100)
    assert [r["threshold"] for r in swept] == pytest.approx(list(grid))
    for r in swept:
        hit = p >= r["threshold"]
        tp, fp, fn, tn = ((hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum(), (~hit & (y == 0)).sum())
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        assert r["expected_value"] == tp * 10 - fp * 3 - fn * 15
        one = evaluation.confusion_counts(df.withColumn("c", (df["p"] >= r["threshold"]).cast("int")), "y", "c").first() if r["threshold"] == swept[40]["threshold"] else None
        if one:
            assert (one["tp"], one["tn"]) == (tp, tn)
    best = evaluation.best_threshold(evaluation.threshold_sweep(df, "y", "p")).first()
    assert best["best_f1_threshold"] == swept[int(np.argmax([r["f1"] for r in swept]))]["threshold"]
    assert best["best_ev_threshold"] == swept[int(np.argmax([r["expected_value"] for r in swept]))]["threshold"]


def test_first_argmax_on_ties(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.2, 2.0), (0.3, 2.0)], "t double, m double")
    assert evaluation.argmax_first(df, "m", "t").first()[0] == 0.2


def test_calibration(spark):
    p = [0.0, 0.1, 0.10001, 0.3, 0.30000000000000004, 0.95, 1.0]
    df = scored(spark, [0, 1, 1, 0, 1, 1, 1], p)
    got = {r["bin"]: (r["fraction_positive"], r["mean_predicted"]) for r in evaluation.calibration_bins(df, "y", "p").collect()}
    bins = np.searchsorted(np.linspace(0, 1, 11)[1:-1], p)
    assert sorted(got) == sorted(set(bins))
    assert got[0] == pytest.approx((0.5, 0.05))


def test_log_loss_is_clipped(spark):
    df = scored(spark, [1, 0], [1.0, 0.0])
    assert evaluation.log_loss(df, "y", "p").first()[0] == pytest.approx(0, abs=1e-12)
    df = scored(spark, [1, 0], [0.0, 0.5])
    assert evaluation.log_loss(df, "y", "p").first()[0] == pytest.approx((-np.log(np.finfo(float).eps) + np.log(2)) / 2)


def test_metric_documents(spark):
    doc = '{"linear_regression": {"rmse": 1.5, "mae": 1.0, "r2": 0.9, "diagnostics": {"x": 1}}, "logistic_regression": {"f1": 0.5, "precision": 0.4, "recall": 0.6, "roc_auc": NaN}}'
    flat = decision.flatten_metrics(spark.createDataFrame([(doc,)], "j string"), "j")
    assert flat.count() == 2
    assert [r["model"] for r in decision.select_by_metric_keys(flat, "regression").collect()] == ["linear_regression"]
    clf = decision.select_by_metric_keys(flat, "classification")
    assert [r["model"] for r in clf.collect()] == ["logistic_regression"]
    table = decision.model_comparison(flat.filter("r2 IS NOT NULL"), clf).collect()
    assert [(r["model"], r["task"], r["r2"]) for r in table] == [("Linear Regression", "Regression", 0.9), ("Logistic Regression", "Classification", None)]
    head = decision.headline_metrics(flat, {"linear_r2": ("linear_regression", "r2")}).first()
    assert head["linear_r2"] == 0.9


def test_leaderboard(spark):
    df = spark.createDataFrame([("a", 3.0, 0.2), ("b", 1.0, 0.9), ("c", 2.0, 0.5)], "model string, rmse double, f1 double")
    assert [r["model"] for r in decision.leaderboard(df, "regression").collect()] == ["b", "c", "a"]
    assert [r["model"] for r in decision.leaderboard(df, "classification").collect()] == ["b", "c", "a"]
