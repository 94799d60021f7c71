"""Centres and mixtures against a plain reading of both methods."""

import numpy as np
import pytest

from gaugeflow.operators import clustering, mixture, supervised


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    parts = [rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + c for c in ([0, 0, 0], [6, 1, -3], [-5, 5, 2])]
    x = np.concatenate(parts)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").cache()


COLS = ["a", "b", "c"]


def scaled(rows):
    x = rows.select(*COLS).toPandas().to_numpy()
    return (x - x.mean(0)) / x.std(0)


def test_a_step_of_the_mixture(rows):
    """Fitted for several passes, one more pass of plain formulas changes next to nothing."""
    fitted = clustering.fit_gmm(rows, COLS, k=3, restarts=3, tol=1e-10)
    x = scaled(rows)
    covariance = [np.linalg.inv(p @ p.T) for p in fitted.whitening]
    density = np.array([
        w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(c))
        for w, m, c in zip(fitted.weights, fitted.centres, covariance)
    ]).T
    assert fitted.cost == pytest.approx(-np.log(density.sum(axis=1)).mean(), abs=1e-6)
    member = density / density.sum(axis=1, keepdims=True)
    n = member.sum(axis=0)
    assert np.allclose(n / n.sum(), fitted.weights, atol=1e-4)
    means = member.T @ x / n[:, None]
    assert np.allclose(means, fitted.centres, atol=1e-3)
    for j in range(3):
        own = (x - means[j]).T @ ((x - means[j]) * member[:, j : j + 1]) / n[j] + 1e-6 * np.eye(3)
        assert np.allclose(own, covariance[j], atol=1e-2)
    got = supervised.predict(fitted, rows).toPandas().sort_values("id")["prediction"].to_numpy()
    assert (got == member.argmax(axis=1)).all()
    assert all(b >= a - 1e-9 for a, b in zip(fitted.history, fitted.history[1:]))  # the likelihood never falls


def test_centres_are_the_means_of_their_rows(rows):
    fitted = clustering.fit_kmeans(rows, COLS, k=3, restarts=6)
    x = scaled(rows)
    d2 = ((x[:, None] - fitted.centres[None]) ** 2).sum(-1)
    own = d2.argmin(axis=1)
    for j in range(3):
        assert np.allclose(x[own == j].mean(0), fitted.centres[j], atol=0.02)
    assert fitted.cost == pytest.approx(d2.min(axis=1).sum(), rel=1e-3)
    worse = clustering.fit_kmeans(rows, COLS, k=3, restarts=1)
    assert fitted.cost <= worse.cost + 1e-9


def test_fewer_rows_than_columns_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(6, 12)), rng.normal(size=(6, 12)) + 40])
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], cols)
    fitted = clustering.fit_gmm(df.unionByName(df.limit(1).withColumn("c3", df["c3"] * None)), cols, k=2, restarts=2)
    labels = [r["prediction"] for r in fitted.transform(df).collect()]
    assert len(set(labels[:6])) == 1 and len(set(labels[6:])) == 1 and labels[0] != labels[6]
    fitted.save(spark, str(tmp_path / "m"))
    again = mixture.Clusters.load(spark, str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(df).collect()] == labels
    one = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    assert {r["prediction"] for r in clustering.fit_kmeans(one, ["a", "b"], k=3, restarts=2).transform(one).collect()} == {0}
    with pytest.raises(ValueError):
        clustering.fit_kmeans(one.filter("false"), ["a", "b"])
