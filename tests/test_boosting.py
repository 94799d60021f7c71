"""Boosting over histograms against a plain reading of the method, and closed forms."""

import numpy as np
import pytest

from gaugeflow.operators import boosting, evaluation, supervised


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(0, 12, 700), rng.normal(size=700), rng.integers(0, 2, 700)]).astype(float)
    y = 2 * x[:, 0] + 5 * x[:, 2] + (x[:, 1] > 0.3) * 4 + rng.normal(size=700) * 0.1
    data = [(*map(float, r), float(v), int(v > 14)) for r, v in zip(x, y)]
    return spark.createDataFrame(data, "a double, b double, c double, y double, flag int").cache()


COLS = ["a", "b", "c"]


def brute(x, y, task, rounds, depth, leaves, rate, min_leaf):
    """Leaf-wise growth by largest gain over all midpoints."""
    score = np.full(len(y), y.mean() if task == "regression" else np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = score if task == "regression" else 1 / (1 + np.exp(-score))
        g, h = p - y, np.ones(len(y)) if task == "regression" else p * (1 - p)

        def best(rows, d):
            found = (-np.inf, None, None)
            if d == depth:
                return found
            for j in range(x.shape[1]):
                values = np.unique(x[:, j])
                for cut in (values[1:] + values[:-1]) / 2:
                    l, r = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(l), len(r)) < min_leaf or min(h[l].sum(), h[r].sum()) < 1e-3:
                        continue
                    gain = g[l].sum() ** 2 / h[l].sum() + g[r].sum() ** 2 / h[r].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > found[0] + 1e-9:
                        found = (gain, j, cut)
            return found

        parts = [(np.arange(len(y)), 0)]
        parts = [(*p, best(*p)) for p in parts]
        while len(parts) < leaves:
            k = max(range(len(parts)), key=lambda i: parts[i][2][0])
            rows, d, (gain, j, cut) = parts[k]
            if not gain > 1e-9:
                break
            sides = [(rows[x[rows, j] <= cut], d + 1), (rows[x[rows, j] > cut], d + 1)]
            parts[k : k + 1] = [(*s, best(*s)) for s in sides]
        for rows, _, _ in parts:
            score[rows] -= rate * g[rows].sum() / h[rows].sum()
    return score if task == "regression" else 1 / (1 + np.exp(-score))


@pytest.mark.parametrize("task,leaves,local", [("regression", 6, 0), ("regression", 31, 10**6), ("classification", 31, 0)])
def test_against_brute_force(rows, task, leaves, local, monkeypatch):
    monkeypatch.setattr(boosting, "LOCAL_SITES", local)
    monkeypatch.setattr(boosting, "KEPT", 2)
    monkeypatch.setattr(boosting, "SLOTS", 3)
    some = rows.limit(150).cache()
    label = "y" if task == "regression" else "flag"
    size = dict(depth=4, leaves=leaves, rate=0.3, min_leaf=5)
    fitted = boosting.fit_boosted_trees(some, COLS, label, task=task, iterations=5, **size)
    pdf = some.toPandas()
    want = brute(pdf[COLS].to_numpy(), pdf[label].to_numpy(float), task, rounds=5, **size)
    got = supervised.predict(fitted, some).select("prediction" if task == "regression" else "score").toPandas().iloc[:, 0]
    if task == "regression":
        assert np.allclose(got, want, atol=1e-8)
    else:  # 0/1 labels give equal gains, whose order rounding decides
        loss = [-np.mean(np.log(np.where(pdf[label] == 1, p, 1 - p))) for p in (got, want)]
        assert loss[0] == pytest.approx(loss[1], rel=0.03)
    assert all((t[0] < 0).sum() <= leaves for t in fitted.trees)


def test_two_valued_feature_has_a_closed_form(rows):
    fitted = boosting.fit_boosted_trees(rows, ["c"], "y", iterations=15, rate=0.1)
    means = rows.groupBy("c").avg("y").toPandas().set_index("c")["avg(y)"]
    mean = rows.agg({"y": "avg"}).first()[0]
    out = fitted.transform(rows).select("c", "prediction").distinct().collect()
    assert len(out) == 2
    for r in out:
        assert r["prediction"] == pytest.approx(means[r["c"]] - (means[r["c"]] - mean) * 0.9**15)


def test_fits_and_keeps(spark, rows, tmp_path):
    for task, label in (("regression", "y"), ("classification", "flag")):
        fitted = supervised.fit_gradient_boosting(rows, COLS, label, task=task, iterations=25)
        assert len(fitted.trees) == 25
        out = supervised.predict(fitted, rows)
        if task == "regression":
            assert evaluation.regression_metrics(out, label, "prediction").first()["r2"] > 0.9
        else:
            assert evaluation.classification_metrics(out, label, "prediction", "score").first()["roc_auc"] > 0.98
        fitted.save(spark, str(tmp_path / task))
        again = boosting.BoostedTrees.load(spark, str(tmp_path / task))
        assert again.transform(rows).select("prediction").collect() == out.select("prediction").collect()


def test_bins(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([([float(i % 7), float(v)],) for i, v in enumerate(rng.normal(size=3000))], "x array<double>")
    few, many = boosting.bin_edges(df, 2)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert 240 <= len(many) <= 254 and (np.diff(many) > 0).all()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, None), (float("nan"), 1.0)], "a double, y double")
    fitted = boosting.fit_boosted_trees(df, ["a"], "y")
    assert fitted.trees == [] and fitted.transform(df.limit(1)).first()["prediction"] == 2.0
    with pytest.raises(ValueError):
        boosting.fit_boosted_trees(df.filter("false"), ["a"], "y")
