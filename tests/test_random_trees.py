"""Extremely random trees: the same forest wherever nodes are grown, and known means."""

import numpy as np
import pytest
from pyspark import SparkContext, cloudpickle

from gaugeflow.operators import clustering, evaluation, neural, random_trees, supervised
from gaugeflow.operators.random_trees import RandomForest, Rule, descend, draws
from gaugeflow.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 30, 900), rng.integers(0, 9, 900), rng.normal(size=900), rng.integers(0, 2, 900)]).astype(float)
    y = np.round(3 * x[:, 0] - 5 * x[:, 1] + 10 * x[:, 3])
    data = [(*map(float, r), float(v), int(v > 30)) for r, v in zip(x, y)]
    return spark.createDataFrame(data, "a double, b double, c double, d double, y double, flag int").cache()


COLS = ["a", "b", "c", "d"]


def as_lists(forest):
    return [[a.tolist() for a in t] for t in forest.trees]


def walk(tree, x):
    feature, cut, left, value = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] + (x[feature[at]] > cut[at])
    return value[at]


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_the_place_of_growth_changes_nothing(rows, task, monkeypatch):
    label = "y" if task == "regression" else "flag"
    found = []
    for local, size in ((8192, 1 << 27), (100, 1 << 27), (1, 20_000)):
        monkeypatch.setattr(random_trees, "LOCAL_ROWS", local)
        monkeypatch.setattr(random_trees, "LEVEL_BYTES", size)
        fitted = random_trees.fit_random_trees(rows.repartition(3 + local % 4), COLS, label, task=task, trees=5, depth=7)
        scored = fitted.transform(rows).select("score" if task == "classification" else "prediction").toPandas()
        found.append(scored.iloc[:, 0].to_numpy())
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])
    x = rows.select(*COLS).toPandas().to_numpy()
    brute = [np.mean([walk(t, r) for t in fitted.trees]) for r in x[:100]]
    assert np.allclose(brute, found[2][:100])


def test_leaves_hold_the_means_of_their_rows(rows):
    fitted = random_trees.fit_random_trees(rows, COLS, "y", trees=3, depth=6, min_leaf=4)
    pdf = rows.toPandas()
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    for feature, cut, left, value in fitted.trees:
        at = descend(x, feature, cut, left)
        for leaf in np.unique(at):
            assert value[leaf] == pytest.approx(y[at == leaf].mean()) and (at == leaf).sum() >= 4
    assert len({str(t) for t in as_lists(fitted)}) == 3


def test_each_node_draws_its_own_cuts():
    codes = np.arange(1, 2000)
    u = draws(42, 3, codes, 4, 0)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and len(np.unique(u)) == u.size
    assert abs(np.corrcoef(u.T)[0, 1]) < 0.1 and not np.array_equal(u, draws(42, 4, codes, 4, 0))
    rule = Rule(4, 2, 1, 5, 42)
    low, high = np.zeros((len(codes), 4)), np.ones((len(codes), 4))
    cuts = rule.cuts(0, codes, low, high)
    assert len(np.unique(cuts)) > 0.99 * cuts.size


def test_square_root_of_features_is_tried():
    rule = Rule(4, 2, 1, 5, 1)
    counts = np.zeros((3000, 3 + 16))
    counts[:, :3] = 10, 0, 50
    counts[:, 3:7] = 5
    counts[:, 7:11] = [10, 5, 2, 1]  # the first feature lowers the error most
    chosen = rule.choose(0, np.arange(1, 3001), 0, counts)
    share = np.bincount(chosen, minlength=4) / 3000
    assert abs(share[0] - 1 / 2) < 0.05 and abs(share[1] - 1 / 3) < 0.05 and abs(share[2] - 1 / 6) < 0.05 and share[3] == 0


def test_save_and_load(spark, rows, tmp_path):
    fitted = random_trees.fit_random_trees(rows, COLS, "flag", task="classification", trees=4, depth=6)
    fitted.save(spark, str(tmp_path / "f"))
    again = RandomForest.load(spark, str(tmp_path / "f"))
    assert as_lists(again) == as_lists(fitted) and again.task == "classification" and again.features == tuple(COLS)
    r = evaluation.classification_metrics(supervised.predict(again, rows), "flag", "prediction", "score").first()
    assert r["roc_auc"] > 0.9


def test_odd_rows(spark):
    one = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, None), (float("nan"), 1.0)], "a double, y double")
    fitted = random_trees.fit_random_trees(one, ["a"], "y", trees=2)
    assert [r[0] for r in fitted.transform(one.limit(1)).select("prediction").collect()] == [2.0]
    with pytest.raises(ValueError):
        random_trees.fit_random_trees(one.filter("false"), ["a"], "y")


def test_every_class_of_model_is_read_back(spark, rows, tmp_path):
    models = {
        "forest": supervised.fit_random_threshold_forest(rows, COLS, "flag", task="classification", trees=3, depth=4),
        "boosted": supervised.fit_gradient_boosting(rows, COLS, "y", iterations=3),
        "clusters": clustering.fit_kmeans(rows, COLS, k=2, restarts=2),
        "perceptron": neural.fit_mlp(rows, rows, COLS, "y", hidden=(3,), epochs=2),
        "pipeline": supervised.fit_linear_regression(rows, COLS, "y"),
    }
    for name, model in models.items():
        for _ in range(2):  # the second time over what the first left
            tables.save_model(model, str(tmp_path / name))
        again = tables.load_model(str(tmp_path / name))
        assert type(again) is type(model)
        first, second = (supervised.predict(m, rows).select("prediction").toPandas() for m in (model, again))
        assert np.allclose(first, second)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_a_large_forest_is_never_held_whole(spark, rows, task, tmp_path, monkeypatch):
    label, out = ("y", "prediction") if task == "regression" else ("flag", "score")
    odd = spark.createDataFrame([(None, 1.0, 2.0, 0.0), (float("nan"), 1.0, -0.0, 0.0), (None, 1.0, 2.0, 0.0)], "a double, b double, c double, d double")
    asked = rows.select(*COLS).unionByName(odd)
    fitted = random_trees.fit_random_trees(rows, COLS, label, task=task, trees=7, depth=5)
    sent = fitted.transform(asked).toPandas().sort_values(COLS)

    def whole(self):
        raise AssertionError("all trees on the driver")

    monkeypatch.setattr(random_trees, "SENT_BYTES", fitted.n_bytes // 3)
    monkeypatch.setattr(random_trees, "BLOCK_BYTES", 100 * 8 * len(COLS))
    monkeypatch.setattr(RandomForest, "trees", property(whole))
    again = random_trees.fit_random_trees(rows, COLS, label, task=task, trees=7, depth=5)
    again.save(spark, str(tmp_path / "f"))
    joined = RandomForest.load(spark, str(tmp_path / "f")).transform(asked).toPandas().sort_values(COLS)
    assert list(joined.columns) == list(sent.columns) and len(joined) == 903
    assert np.allclose(joined.to_numpy(), sent.to_numpy(), equal_nan=True)


def test_no_worker_is_sent_a_large_forest(rows, monkeypatch):
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: sent.append(len(cloudpickle.dumps(v))) or broadcast(self, v))
    fitted = random_trees.fit_random_trees(rows, COLS, "y", trees=9, depth=8)
    size = sum(a.nbytes for tree in fitted.trees for a in tree)
    monkeypatch.setattr(random_trees, "SENT_BYTES", size // 3, raising=False)
    scored = fitted.transform(rows).agg({"prediction": "count"}).first()[0]
    assert scored == 900 and sent and max(sent) < size // 3


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_bagged_trees_grow_alike_in_tasks_and_by_levels(rows, task, monkeypatch):
    label, out = ("y", "prediction") if task == "regression" else ("flag", "score")
    found = []
    for local, size in ((8192, 1 << 27), (100, 1 << 27), (1, 200_000)):
        monkeypatch.setattr(random_trees, "LOCAL_ROWS", local)
        monkeypatch.setattr(random_trees, "LEVEL_BYTES", size)
        monkeypatch.setattr(random_trees, "COUNT_BYTES", size // 10)
        fitted = supervised.fit_random_forest(rows.repartition(3 + local % 4), COLS, label, task=task, trees=5, depth=7)
        found.append(fitted.transform(rows.orderBy(*COLS)).select(out).toPandas()[out].to_numpy())
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


def test_bagged_trees_work_on_equal_rows_once(rows, monkeypatch):
    """Rows of the same bins and label are one site, however many they are."""
    seen, grow = [], random_trees.grow_forest

    def spied(sites, rule, trees, low, high, n_sites):
        seen.append((n_sites, sites.agg({"n": "sum"}).first()[0]))
        return grow(sites, rule, trees, low, high, n_sites)

    monkeypatch.setattr(random_trees, "grow_forest", spied)
    few = rows.select("a", "b", "d", "flag")
    many = few.crossJoin(few.sparkSession.range(200).select())
    for df in (few, many):
        supervised.fit_random_forest(df, ["a", "b", "d"], "flag", task="classification", trees=2, depth=4)
    assert seen[0][0] == seen[1][0] <= 30 * 9 * 2 * 2 and seen[1][1] == 200 * seen[0][1] == 200 * 900


def test_bagged_leaves_hold_the_means_of_their_bootstrap(rows):
    model = supervised.fit_random_forest(rows, COLS, "y", trees=3, depth=5, min_leaf=4)
    pdf = rows.toPandas()
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    edges = tuple(random_trees.bin_edges(rows.selectExpr("array(a, b, c, d) AS x"), 4, random_trees.BINS))
    rule = random_trees.BaggedRule(4, 4, 4, 5, random_trees.defaults.SEED, edges)
    ends = np.column_stack([np.append(e, np.inf)[np.searchsorted(e, x[:, j])] for j, e in enumerate(edges)])
    sites, at = np.unique(np.column_stack((ends, y)), axis=0, return_inverse=True)
    n = np.bincount(at).astype(float)
    w = np.column_stack((n, n * sites[:, 4], n * sites[:, 4] ** 2))
    for t, (feature, cut, left, value) in enumerate(model.trees):
        drawn = rule.weigh(t, sites[:, :4], w)
        assert abs(drawn[:, 0].sum() - 900) < 150 and not np.array_equal(drawn, w)
        leaf = descend(sites[:, :4], feature, cut, left)
        for k in np.unique(leaf):
            here = drawn[leaf == k].sum(axis=0)
            assert here[0] >= 4 and value[k] == pytest.approx(here[1] / here[0])


def test_poisson_numbers():
    u, v = np.random.default_rng(3).random((2, 200_000))
    for mean in (1.0, 7.0, 99.0, 101.0, 5000.0):
        k = random_trees.poisson(np.full(len(u), mean), u, v)
        assert np.array_equal(k, np.floor(k)) and k.min() >= 0
        assert k.mean() == pytest.approx(mean, rel=0.01) and k.var() == pytest.approx(mean, rel=0.02)
        skew = ((k - k.mean()) ** 3).mean() / k.std() ** 3
        assert skew == pytest.approx(mean**-0.5, abs=0.03)
    assert (random_trees.poisson(np.ones(len(u)), u, v) == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_bagged_trees_refuse_rows_that_lack_a_value(spark, rows):
    odd = spark.createDataFrame([(None, 1.0, 2.0, 0.0, 1.0, 1)], rows.schema)
    with pytest.raises(ValueError):
        supervised.fit_random_forest(rows.union(odd), COLS, "y", trees=1)
    model = supervised.fit_random_forest(rows, COLS, "y", trees=1, depth=2)
    with pytest.raises(Exception, match="lacks a feature"):
        model.transform(odd).collect()


def test_bagged_trees_of_more_classes(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(60)], "a double, k double")
    out = supervised.predict(supervised.fit_random_forest(df.selectExpr("k AS a", "k"), ["a"], "k", task="classification", trees=5), df.selectExpr("k AS a", "k"))
    assert out.filter("prediction <> k").count() == 0
