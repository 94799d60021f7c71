import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import kernels
from gaugeflow.operators import clustering, density, describe, diagnostics, evaluation, features, neural, supervised
from gaugeflow.plans import gradient
from gaugeflow.plans.graph import connected_components


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        a, b = rng.normal(), rng.normal() * 3 + 5
        y = 4 * a - b + 0.1 * rng.normal()
        rows.append((i, float(a), float(b), float(y), int(y > -5)))
    return spark.createDataFrame(rows, "id long, a double, b double, y double, flag int").cache()


def test_linear_matches_least_squares(points):
    pdf = points.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b"]])
    beta = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    got = supervised.predict(supervised.fit_linear_regression(points, ["a", "b"], "y"), points).toPandas()
    np.testing.assert_allclose(got["prediction"], x @ beta, rtol=1e-8)
    assert list(got.columns) == [*pdf.columns, "prediction"]


def test_logistic_minimises_the_penalised_loss(points):
    model = supervised.fit_logistic_regression(points, ["a", "b"], "flag")
    fitted = model.stages[-1]
    pdf = points.toPandas()
    z = ((pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)).to_numpy()
    w, c = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(z @ w + c)))
    grad = z.T @ (p - pdf["flag"].to_numpy()) + w  # summed loss with C = 1
    assert np.abs(grad).max() < 0.05
    out = supervised.predict(model, points)
    assert out.filter((F.col("score") > 0.5) != (F.col("prediction") == 1)).count() == 0


@pytest.mark.parametrize("fit", [supervised.fit_random_forest, supervised.fit_random_threshold_forest, supervised.fit_gradient_boosting])
@pytest.mark.parametrize("task", ["regression", "classification"])
def test_trees(points, fit, task):
    size = dict(iterations=5, depth=3) if fit is supervised.fit_gradient_boosting else dict(trees=6, depth=6)
    model = fit(points, ["a", "b"], "y" if task == "regression" else "flag", task=task, **size)
    out = supervised.predict(model, points)
    if task == "regression":
        assert evaluation.regression_metrics(out, "y", "prediction").first()["r2"] > 0.5
    else:
        r = evaluation.classification_metrics(out, "flag", "prediction", "score").first()
        assert r["roc_auc"] > 0.9 and r["f1"] > 0.8


def test_permutation_importance(points):
    model = supervised.fit_linear_regression(points, ["a", "b"], "y")
    df = points.withColumn("noise", F.rand(1))
    for block_rows in (10_000, 100):
        got = {
            r["feature"]: r["importance"]
            for r in diagnostics.permutation_importance(
                df, lambda x: supervised.predict(model, x), ["a", "b", "noise"], "y", ["id"], repeats=2, block_rows=block_rows
            ).collect()
        }
        assert got["a"] > got["b"] > 0.1 and got["noise"] == pytest.approx(0, abs=1e-12)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_mlp(spark, points, task, tmp_path):
    split = features.chronological_split(points, ["id"])
    train, val = split.filter("split = 'train'"), split.filter("split = 'val'")
    label = "y" if task == "regression" else "flag"
    model = neural.fit_mlp(train, val, ["a", "b"], label, task=task, hidden=(16,), rate=0.05, epochs=60, patience=20)
    first, last = model.history[0], model.history[-1]
    assert last[1] < first[1] / 2
    out = model.transform(points)
    if task == "regression":
        assert evaluation.regression_metrics(out, label, "prediction").first()["r2"] > 0.9
    else:
        assert evaluation.classification_metrics(out, label, "prediction", "score").first()["roc_auc"] > 0.95
    model.save(spark, str(tmp_path / "m"))
    again = neural.MlpModel.load(spark, str(tmp_path / "m"))
    assert again.transform(points).first()["prediction"] == out.first()["prediction"]
    assert again.history_frame(spark).count() == len(model.history)


@pytest.mark.parametrize("task,label", [("regression", "y"), ("classification", "flag")])
def test_mlp_steps_are_the_same_in_one_task_and_in_many(points, task, label, monkeypatch):
    monkeypatch.setattr(gradient, "SLOTS", 3)
    size = dict(task=task, hidden=(4,), epochs=2, rate=0.01)
    val = points.filter("id % 5 = 0")
    alone = neural.fit_mlp(points, val, ["a", "b"], label, **size)
    monkeypatch.setattr(neural, "LOCAL_VALUES", 0)
    spread = neural.fit_mlp(points.repartition(7), val, ["a", "b"], label, **size)
    assert np.allclose(alone.weights, spread.weights, atol=1e-9) and np.allclose(alone.history, spread.history)
    none = neural.fit_mlp(points.limit(5), val.filter("false"), ["a", "b"], label, **size)
    assert all(h[1] == h[2] for h in none.history)
    with pytest.raises(ValueError):
        neural.fit_mlp(points.filter("false"), val, ["a", "b"], label)


def test_a_step_is_one_job_over_the_partitions_of_its_batch(spark, points, monkeypatch):
    monkeypatch.setattr(neural, "LOCAL_VALUES", 0)
    monkeypatch.setattr(neural, "SHARD_ROWS", 30)
    monkeypatch.setattr(neural, "SLICE", 11)
    size = dict(hidden=(4,), epochs=3, rate=0.01)
    val, found, planned = points.filter("id % 5 = 0"), [], []
    plain = type(points).filter
    monkeypatch.setattr(type(points), "filter", lambda df, *a: planned.append(a) or plain(df, *a))
    for parts in (1, 7):
        found.append(neural.fit_mlp(points.repartition(parts), val, ["a", "b"], "y", **size))
    assert not planned
    # the cut into shards follows the rows alone
    assert np.allclose(found[0].weights, found[1].weights, atol=1e-12) and np.allclose(found[0].history, found[1].history)


@pytest.mark.parametrize("task,label", [("regression", "y"), ("classification", "flag")])
def test_a_fit_is_one_stage_whatever_its_epochs(spark, points, task, label, monkeypatch):
    monkeypatch.setattr(neural, "LOCAL_VALUES", 0)
    monkeypatch.setattr(neural, "SHARD_ROWS", 30)
    val, jobs, found = points.filter("id % 5 = 0"), [], []

    def fit(epochs, rows=points, **size):
        return neural.fit_mlp(rows, val, ["a", "b"], label, task=task, hidden=(4,), epochs=epochs, rate=0.01, **size)

    for epochs in (2, 5):
        spark.sparkContext.setJobGroup(group := f"fit-{task}-{epochs}", group)
        found.append(fit(epochs))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    one = points.filter("id = 7").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(100))))
    found.append(fit(2, one))  # all rows are with one task
    monkeypatch.setattr(neural, "_slots", lambda context: 0)  # where tasks cannot wait for each other
    for model, again in zip(found, (fit(2), fit(5), fit(2, one))):
        assert (model.weights == again.weights).all() and model.history == again.history


def test_tasks_exchange_sums_by_files(tmp_path):
    def run(task):
        exchange = neural.Exchange(str(tmp_path), task, 3)
        return [sum(float(g.sum()) for g in exchange.gather(np.full((task, 50), float(turn + task)))) for turn in range(40)]

    with ThreadPoolExecutor() as pool:
        found = list(pool.map(run, range(3)))
    want = [50.0 * sum(k * (turn + k) for k in range(3)) for turn in range(40)]
    assert found == [want] * 3
    assert len(list(tmp_path.iterdir())) == 6


def test_a_linear_network_is_least_squares(points):
    fitted = neural.fit_mlp(points, points, ["a", "b"], "y", hidden=(), rate=0.05, epochs=300, alpha=0.0, patience=300)
    pdf = points.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b"]])
    best = x @ np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    got = fitted.transform(points).toPandas()["prediction"]
    assert np.abs(got - best).max() < 0.05


def test_mlp_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    for task in ("regression", "classification"):
        shape = neural.Shape((3, 4, 2, 1), "tanh", task)
        flat = shape.start(1)

        def loss(w):
            p = shape.forward(w, x)[-1][:, 0]
            fit = ((p - y) ** 2 / 2).mean() if task == "regression" else -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            return fit + 0.1 * sum((m**2).sum() for m, _ in shape.layers(w)) / 2 / len(x)

        g = shape.gradient(flat, x, y, 0.1)
        for i in range(0, len(flat), 3):
            e = np.zeros_like(flat)
            e[i] = 1e-6
            assert g[i] == pytest.approx((loss(flat + e) - loss(flat - e)) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        c = i % 3
        rows.append((i, float(c * 10 + rng.normal()), float(c * -5 + rng.normal()), c))
    return spark.createDataFrame(rows, "id long, x double, y double, truth int").cache()


@pytest.mark.parametrize("fit", [clustering.fit_kmeans, clustering.fit_gmm, clustering.fit_hierarchical])
def test_clusterers_find_blobs(blobs, fit):
    extra = dict(micro=20) if fit is clustering.fit_hierarchical else dict(restarts=2)
    out = supervised.predict(fit(blobs, ["x", "y"], k=3, **extra), blobs)
    assert out.groupBy("truth").agg(F.count_distinct("prediction").alias("n")).filter("n > 1").count() == 0
    assert out.select("prediction").distinct().count() == 3


def brute_silhouette(x, c, square):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if square else np.sqrt(d)
    out = []
    for i in range(len(x)):
        own = c == c[i]
        a = d[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else None
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return np.mean(out)


def test_quality_measures(blobs):
    df = blobs.withColumn("c", F.when(F.col("id") == 7, -1).when(F.col("id") % 4 == 0, 1).otherwise(F.col("truth")))
    pdf = df.toPandas()
    x, c = pdf[["x", "y"]].to_numpy(), pdf["c"].to_numpy()
    for tile in (50, 2048):
        got = clustering.silhouette(df, "c", ["x", "y"], "id", tile_rows=tile).first()[0]
        assert got == pytest.approx(brute_silhouette(x, c, False))
    assert clustering.silhouette_sq(df, "c", ["x", "y"]).first()[0] == pytest.approx(brute_silhouette(x, c, True))
    m = {k: x[c == k].mean(0) for k in set(c)}
    s = {k: np.sqrt(((x[c == k] - m[k]) ** 2).sum(1)).mean() for k in m}
    dbi = np.mean([max((s[i] + s[j]) / np.linalg.norm(m[i] - m[j]) for j in m if j != i) for i in m])
    assert clustering.davies_bouldin(df, "c", ["x", "y"]).first()[0] == pytest.approx(dbi)
    r = clustering.cluster_metrics(df, "c", ["x", "y"], "id", squared=False).first()
    z = (x - x.mean(0)) / x.std(0)
    assert r["silhouette_score"] == pytest.approx(brute_silhouette(z, c, False))
    assert (r["n_clusters"], r["noise_ratio"]) == (3, pytest.approx(1 / 300))
    r = clustering.cluster_metrics(df, "c", ["x", "y"], "id").first()
    assert r["silhouette_score"] == pytest.approx(brute_silhouette(z, c, True))


def test_quality_is_missing_below_two_clusters(blobs):
    df = blobs.withColumn("c", F.when(F.col("id") < 9, -1).otherwise(0))
    r = clustering.cluster_metrics(df, "c", ["x", "y"], "id", squared=False).first()
    assert (r["silhouette_score"], r["davies_bouldin_index"], r["n_clusters"]) == (None, None, 1)


def test_cluster_profile(blobs):
    out = describe.cluster_profile(blobs, "truth", ["x", "y"]).toPandas().sort_values("truth")
    m = blobs.toPandas().groupby("truth")[["x", "y"]].mean()
    np.testing.assert_allclose(out[["x", "y"]], (m - m.mean()) / m.std())


def test_projection(blobs):
    out = clustering.project_2d(blobs, ["x", "y"], ["id"]).toPandas()
    assert len(out) == 300 and out["x"].var() > out["y"].var()


def brute_dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] >= 0:
                continue
            label[j] = k
            if core[j]:
                todo += list(np.flatnonzero(near[j] & (label < 0)))
        k += 1
    return core, label


@pytest.mark.parametrize("dims,eps,tile", [(2, 0.35, 16), (2, 0.35, 1000), (4, 1.0, 40), (8, 2.2, 25), (64, 9.0, 30)])
def test_dbscan_against_brute_force(spark, dims, eps, tile):
    rng = np.random.default_rng(dims)
    x = np.round(np.concatenate([rng.normal(size=(120, dims)), rng.normal(size=(40, dims)) * 0.1 + 4, rng.uniform(-5, 8, (40, dims))]), 3)
    x = np.concatenate([x, np.repeat(x[:1], 100, axis=0)])  # a third of the rows are one point
    cols = [f"d{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *cols])
    out = density.dbscan(df, cols, "id", eps=eps, min_samples=6, tile_rows=tile).toPandas().sort_values("id")
    core, label = brute_dbscan(x, eps, 6)
    assert (out["is_core"].to_numpy() == core).all()
    assert (out["label"].to_numpy() == label).all()
    assert len(set(label)) > 2


def test_distances_by_a_product():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64)) / 8 + 50 * rng.integers(0, 4, (300, 1))
    x[7], x[9] = x[8], x[8] + 1e-9  # equal rows, and nearly equal ones
    exact = kernels.distances(x, x[:200])
    np.testing.assert_allclose(kernels.fast_distances(x, x[:200]), exact, rtol=1e-8)
    for eps in (0.0, 1e-8, 1.19, exact[3, 4], np.nextafter(exact[3, 4], 0), 100.0, -1.0):
        assert (kernels.within(x, x[:200], eps) == (exact <= eps)).all()
    x[5, 5], x[6, 6] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert (kernels.within(x, x[:200], 1.19) == (kernels.distances(x, x[:200]) <= 1.19)).all()
    wide = rng.normal(size=(1000, 64))
    seconds = []
    for f in (kernels.distances, kernels.fast_distances, lambda a, b: kernels.within(a, b, 1.19)):
        began = time.process_time()
        f(wide, wide)
        seconds.append(time.process_time() - began)
    assert max(seconds[1:]) < 0.7 * seconds[0]


def test_silhouette_sends_few_copies_of_large_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, c = np.round(rng.normal(size=(400, 9)), 3), rng.integers(0, 3, 400)
    cols = [f"d{i}" for i in range(9)]
    df = spark.createDataFrame([(i, int(k), *map(float, r)) for i, (k, r) in enumerate(zip(c, x))], ["id", "c", *cols])
    monkeypatch.setattr(clustering, "GROUPS", 2)
    monkeypatch.setattr(clustering, "MOST_ROWS", 100)
    sent = clustering.silhouette(df, "c", cols, "id", tile_rows=10)
    assert "sequence(0, 3," in sent._jdf.queryExecution().analyzed().toString()
    assert sent.first()[0] == pytest.approx(brute_silhouette(x, c, False))


def test_pivots_leave_most_tiles_out(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 64)) * 30
    x = np.concatenate([c + rng.normal(size=(50, 64)) for c in centres])
    sites = spark.createDataFrame([(i, list(map(float, r)), 1, None) for i, r in enumerate(x)], "pid long, x array<double>, wt long, spot long")
    chosen = density._pivots(sites, 3)
    assert len({tuple(p) for p in chosen}) == 3 and all(list(p) in x.tolist() for p in chosen)
    placed = sites.withColumn("at", F.array(*[density._distance(F.col("x"), p) for p in chosen]))
    tiles = density._with_tiles(placed, 3, 13.0, 50).select(F.explode("tiles").alias("t")).select("t.*")
    sides = tiles.groupBy("lo", "hi").agg(F.sum(F.col("left").cast("int")).alias("l"), F.count("*").alias("n")).collect()
    compared = sum(r["l"] * (r["n"] if r["lo"] == r["hi"] else r["n"] - r["l"]) for r in sides)
    assert compared < 0.25 * len(x) ** 2
    assert all(r["n"] <= 200 for r in sides)


def test_dbscan_crowded_spots(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(150, 2)) * 0.02, rng.normal(size=(80, 2)) * 0.02 + [0.5, 0], rng.uniform(-2, 2, (60, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", "a", "b"])
    merged = df.select(F.array("a", "b").alias("x"), F.col("id").alias("pid"), F.lit(1).alias("wt"))
    spots = density._with_spots(merged, 2, 0.3, 5, 20).filter("spot IS NOT NULL").groupBy("spot").count().collect()
    assert len(spots) >= 2 and sum(r["count"] for r in spots) > 200
    out = density.dbscan(df, ["a", "b"], "id", eps=0.3, min_samples=5, tile_rows=20).toPandas().sort_values("id")
    core, label = brute_dbscan(x, 0.3, 5)
    assert (out["is_core"].to_numpy() == core).all() and (out["label"].to_numpy() == label).all()


def test_dbscan_all_noise(spark):
    df = spark.createDataFrame([(i, float(i * 100)) for i in range(20)], "id long, x double")
    out = density.dbscan(df, ["x"], "id", eps=1.0, min_samples=2)
    assert out.filter("label = -1 AND NOT is_core").count() == 20
    assert dict(out.dtypes)["x"] == "double"


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(205, 200), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in (200, 201, 205)}
    assert got == want


def test_perceptron_does_not_follow_the_partitions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    rows = [(*map(float, v), float(v[0] - v[1])) for v in x]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fits = [
        neural.fit_mlp(given, given, ["a", "b"], "y", hidden=(4,), epochs=2).weights
        for given in (df.repartition(3), df.repartition(11))
    ]
    assert np.allclose(fits[0], fits[1], atol=1e-9)
