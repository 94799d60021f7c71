"""Centres and full-covariance Gaussian mixtures; all restarts share every pass over the rows.

A pass adds up mergeable statistics (counts, sums, outer products) of all restarts in one job.
Seeds are drawn by squared distance (k-means++): the row with the largest ``log(u) / d2`` is such
a draw when ``u`` is uniform, and a hash of the row gives the same ``u`` in any task.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.scaling import busy_partitions
from gaugeflow.plans import defaults
from gaugeflow.plans.gradient import summed_gradient
from gaugeflow.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Shift of the centres, as a share of the mean variance, at which they have settled.
SETTLED = 1e-4


@dataclass
class Clusters:
    """Fitted centres or, with ``whitening``, Gaussians over scaled columns; ``transform`` adds ``prediction``."""

    cols: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    centres: np.ndarray
    cost: float
    history: list[float]
    weights: np.ndarray | None = None
    whitening: np.ndarray | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(T.IntegerType())
        def nearest(xs: pd.Series) -> pd.Series:
            x = (np.stack(xs.to_numpy()) - model.mean) / model.std if len(xs) else np.zeros((0, len(model.cols)))
            if model.whitening is None:
                return pd.Series(_squares(x, model.centres).argmin(axis=1))
            return pd.Series(_densities(x, model.weights, model.centres, model.whitening).argmax(axis=1))

        return df.withColumn("prediction", nearest(F.array(*[F.col(c).cast("double") for c in self.cols])))

    def save(self, spark, path: str) -> None:
        doc = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        spark.createDataFrame([(json.dumps(doc),)], "value string").write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> Clusters:
        doc = json.loads(spark.read.text(path).first()[0])
        return Clusters(tuple(doc.pop("cols")), **{k: np.array(v) if isinstance(v, list) and k != "history" else v for k, v in doc.items()})


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0)


def _densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, whitening: np.ndarray) -> np.ndarray:
    """Log of weight times density, per row and component; ``whitening`` turns a covariance into the unit."""
    out = np.empty((len(x), len(means)))
    for j, (w, m, p) in enumerate(zip(weights, means, whitening)):
        y = (x - m) @ p
        out[:, j] = np.log(w) + np.log(np.diag(p)).sum() - 0.5 * (y * y).sum(axis=1) - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _prepared(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``x, h``: scaled rows without missing values and a hash of each; the scaling."""
    given = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    given = cut_lineage(given.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    at = [F.get("x", F.lit(i)) for i in range(len(cols))]
    stats = given.agg(*[F.avg(a).alias(f"m{i}") for i, a in enumerate(at)], *[F.stddev_pop(a).alias(f"s{i}") for i, a in enumerate(at)]).first()
    if stats["m0"] is None:
        raise ValueError("cannot fit clusters without rows")
    mean, std = (np.array([stats[f"{name}{i}"] for i in range(len(cols))]) for name in "ms")
    std = np.where(std > 0, std, 1.0)
    scaled = F.zip_with("x", F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std)]), lambda v, k: (v - k["m"]) / k["s"])
    rows = busy_partitions(cut_lineage(given.select(scaled.alias("x"), F.xxhash64("x").alias("h"))))
    return rows, mean, std


def _seeds(rows: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """``(restarts, k, columns)``: one job per seed for all restarts."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(restarts)]
    for step in range(k):

        def draw(frames: Iterator[pd.DataFrame], step=step) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[float, np.ndarray]] = {}
            for frame in frames:
                if not len(frame):
                    continue
                x, h = np.stack(frame["x"].to_numpy()), frame["h"].to_numpy().astype(np.uint64)
                for r in range(restarts):
                    mixed = (h ^ np.uint64(seed * 1_000_003 + r * 8191 + step)) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    u = ((mixed >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
                    d2 = _squares(x, np.array(chosen[r])).min(axis=1) if chosen[r] else np.ones(len(x))
                    key = np.log(u) / np.maximum(d2, 1e-300)
                    i = int(key.argmax())
                    if r not in best or key[i] > best[r][0]:
                        best[r] = (float(key[i]), x[i])
            if best:
                yield pd.DataFrame({"r": list(best), "key": [b[0] for b in best.values()], "x": [b[1] for b in best.values()]})

        drawn = rows.mapInPandas(draw, "r int, key double, x array<double>")
        for row in drawn.groupBy("r").agg(F.max(F.struct("key", "x")).alias("best")).collect():
            chosen[row["r"]].append(np.array(row["best"]["x"]))
    return np.array(chosen)


def _settled_centres(rows: DataFrame, k: int, restarts: int, max_iter: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of all restarts after Lloyd's steps, and the summed squared distances of each."""
    centres = _seeds(rows, k, restarts, seed)
    d = centres.shape[2]

    def sums(flat: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, float, int]:
        x = np.stack(frame["x"].to_numpy())
        out = np.zeros((restarts, k * (d + 1) + 1))
        for r, own in enumerate(flat.reshape(restarts, k, d)):
            d2 = _squares(x, own)
            member = np.zeros((len(x), k))
            member[np.arange(len(x)), d2.argmin(axis=1)] = 1
            out[r] = np.concatenate((member.sum(axis=0), (member.T @ x).ravel(), [d2.min(axis=1).sum()]))
        return out.ravel(), 0.0, len(x)

    for _ in range(max_iter):
        total, _, n = summed_gradient(rows, sums, centres.ravel(), restarts * (k * (d + 1) + 1))
        total = total.reshape(restarts, -1)
        count, summed, cost = total[:, :k], total[:, k:-1].reshape(restarts, k, d), total[:, -1]
        moved = np.where(count[:, :, None] > 0, summed / np.maximum(count, 1)[:, :, None], centres)
        shift = ((moved - centres) ** 2).sum(axis=(1, 2)).max()
        centres = moved
        if shift <= SETTLED:  # columns have variance 1
            break
    return centres, cost


def fit_centres(df: DataFrame, cols: Sequence[str], k: int, restarts: int, max_iter: int, seed: int = defaults.SEED) -> Clusters:
    """Lloyd's centres on scaled columns, the best of all restarts by summed squared distance.

    Rows with a missing value are left out of the fit; none at all is an error. A centre that
    loses its rows stays where it is.
    """
    rows, mean, std = _prepared(df, cols)
    rows = rows.persist()
    try:
        centres, cost = _settled_centres(rows, k, restarts, max_iter, seed)
    finally:
        rows.unpersist()
    best = int(cost.argmin())
    return Clusters(tuple(cols), mean, std, centres[best], float(cost[best]), [])


def fit_mixture(
    df: DataFrame, cols: Sequence[str], k: int, restarts: int, max_iter: int, tol: float, ridge: float, seed: int = defaults.SEED
) -> Clusters:
    """Expectation maximisation on scaled columns, the restart of largest likelihood.

    Every restart begins with its own settled centres. ``ridge`` is added to the variances, so
    that groups with fewer rows than columns have a covariance. ``cost`` is the mean negative
    log-likelihood of a row, ``history`` that of the best restart after each pass.
    """
    rows, mean, std = _prepared(df, cols)
    d = len(cols)
    size = k * (1 + d + d * d)
    rows = rows.persist()
    try:
        centres, _ = _settled_centres(rows, k, restarts, 20, seed)

        def sums(flat: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, float, int]:
            x = np.stack(frame["x"].to_numpy())
            out = np.zeros((restarts, size + 1))
            for r, own in enumerate(flat.reshape(restarts, -1)):
                if first:
                    member = np.zeros((len(x), k))
                    member[np.arange(len(x)), _squares(x, own.reshape(k, d)).argmin(axis=1)] = 1
                else:
                    weights, means, whitening = own[:k], own[k : k + k * d].reshape(k, d), own[k + k * d :].reshape(k, d, d)
                    logs = _densities(x, weights, means, whitening)
                    top = logs.max(axis=1)
                    each = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
                    member = np.exp(logs - each[:, None])
                    out[r, -1] = each.sum()
                outer = [(x * member[:, j : j + 1]).T @ x for j in range(k)]
                out[r, :-1] = np.concatenate((member.sum(axis=0), (member.T @ x).ravel(), np.array(outer).ravel()))
            return out.ravel(), 0.0, len(x)

        first, flat, likelihoods = True, centres.ravel(), []
        for _ in range(max_iter + 1):
            total, _, n = summed_gradient(rows, sums, flat, restarts * (size + 1))
            total = total.reshape(restarts, size + 1)
            if not first:
                likelihoods.append(total[:, -1] / n)
                fitted = flat.reshape(restarts, -1)
                if len(likelihoods) > 1 and np.max(likelihoods[-1] - likelihoods[-2]) < tol:
                    break
            first = False
            flat = np.concatenate([_maximised(row[:-1], n, k, d, ridge) for row in total])
    finally:
        rows.unpersist()
    best = int(likelihoods[-1].argmax())
    own = fitted[best]
    return Clusters(
        tuple(cols), mean, std, own[k : k + k * d].reshape(k, d), float(-likelihoods[-1][best]),
        [float(v[best]) for v in likelihoods], own[:k], own[k + k * d :].reshape(k, d, d),
    )


def _maximised(total: np.ndarray, n: int, k: int, d: int, ridge: float) -> np.ndarray:
    """Weights, means and whitening matrices from summed statistics."""
    count, summed, outer = total[:k] + 10 * np.finfo(float).eps, total[k : k + k * d].reshape(k, d), total[k + k * d :].reshape(k, d, d)
    means = summed / count[:, None]
    whitening = []
    for j in range(k):
        covariance = outer[j] / count[j] - np.outer(means[j], means[j]) + ridge * np.eye(d)
        whitening.append(np.linalg.inv(np.linalg.cholesky((covariance + covariance.T) / 2)).T)
    return np.concatenate((count / count.sum(), means.ravel(), np.array(whitening).ravel()))
