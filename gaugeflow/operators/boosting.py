"""Histogram gradient boosting with leaf-wise trees.

Features become at most 255 bins once; rows that fall into the same bins in all features have the
same score in every round, so they are one weighted site, which loses nothing. A level of a tree
is one job that adds up gradients, curvatures and rows per (node, feature, bin); of two siblings
only the one with fewer rows is counted, the other is its parent less that. Levels are grown to
``depth``; the tree then keeps the cuts that growing by largest gain first would make. Scores are
written with the sites every ``KEPT`` rounds; in between, tasks apply the trees since.

``LOCAL_SITES`` sites or fewer, of however many rows, are fitted by one task with the same steps: a
job per level would cost far more than its work.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.random_trees import bin_edges, descend
from gaugeflow.operators.scaling import busy_partitions
from gaugeflow.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

BINS = 255
#: Sites that one task fits alone.
LOCAL_SITES = 65_536
#: Rounds whose trees tasks apply themselves before the scores are written.
KEPT = 10
#: Curvature that a leaf needs.
LEAST_CURVATURE = 1e-3
#: Histograms that the driver adds up; beyond, tasks add them up in groups first.
SLOTS = 32

#: A tree: feature of each node (-1: leaf), cut, left child (the right one follows it), value.
TREE = {"feature": np.int16, "cut": np.float64, "left": np.int32, "value": np.float64}
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class BoostedTrees:
    """The fitted sum of trees; ``transform`` adds ``prediction`` (and ``score`` for classes)."""

    features: tuple[str, ...]
    task: str
    start: float
    trees: list[Tree]

    def transform(self, df: DataFrame) -> DataFrame:
        start, trees, width = self.start, self.trees, len(self.features)

        @F.pandas_udf(T.DoubleType())
        def total(xs: pd.Series) -> pd.Series:
            x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, width))
            return pd.Series(margins(x, start, trees))

        raw = total(F.array(*[F.col(c).cast("double") for c in self.features]))
        if self.task == "regression":
            return df.withColumn("prediction", raw)
        return df.withColumn("score", 1 / (1 + F.exp(-raw))).withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def save(self, spark, path: str) -> None:
        trees = [[a.tolist() for a in t] for t in self.trees]
        doc = json.dumps(dict(features=self.features, task=self.task, start=self.start, trees=trees))
        spark.createDataFrame([(doc,)], "value string").write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> BoostedTrees:
        doc = json.loads(spark.read.text(path).first()[0])
        trees = [tuple(np.array(a, k) for a, k in zip(t, TREE.values())) for t in doc["trees"]]
        return BoostedTrees(tuple(doc["features"]), doc["task"], doc["start"], trees)


def margins(x: np.ndarray, start: float | np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    out = np.zeros(len(x)) + start
    for feature, cut, left, value in trees:
        out += value[descend(x, feature, cut, left)]
    return out


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    task: str = "regression",
    depth: int = 8,
    leaves: int = 31,
    rate: float = 0.08,
    iterations: int = 300,
    min_leaf: int = 25,
) -> BoostedTrees:
    """Fit to squared error, or to log-loss of a 0/1 label.

    Rows with a missing feature or label are left out; no rows at all is an error. A round whose
    tree finds no cut ends the fit, as all later ones would.
    """
    features = tuple(features)
    width = len(features)
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = train.select(x.alias("x"), F.col(label).cast("double").alias("y"))
    rows = cut_lineage(rows.filter(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    total = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
    if not total["n"]:
        raise ValueError("cannot fit trees without rows")
    edges = bin_edges(rows, width, BINS)
    start = total["mean"]
    if task != "regression":
        sure = min(max(start, 1e-12), 1 - 1e-12)
        start = float(np.log(sure / (1 - sure)))
    sites = cut_lineage(_sites(rows, edges).withColumn("margin", F.lit(start)))
    size = dict(depth=depth, leaves=leaves, min_leaf=min_leaf, rate=rate)
    fit = _fit_in_task if sites.count() <= LOCAL_SITES else _fit_by_level
    return BoostedTrees(features, task, start, [_with_values(t, edges) for t in fit(sites, width, task, iterations, size)])


def _fit_by_level(sites: DataFrame, width: int, task: str, iterations: int, size: dict) -> list[Tree]:
    trees: list[Tree] = []
    recent: list[Tree] = []
    held = busy_partitions(sites).persist()
    partitions = held.rdd.getNumPartitions()
    try:
        for _ in range(iterations):
            tree = _grow(lambda *a: _histograms(held, partitions, width, recent, task, *a), **size)
            if len(tree[0]) == 1:
                break
            trees.append(tree)
            recent.append(tree)
            if len(recent) == KEPT:
                moved = busy_partitions(_with_margins(held, width, recent)).persist()
                held.unpersist()
                held, partitions, recent = moved, moved.rdd.getNumPartitions(), []
    finally:
        held.unpersist()
    return trees


def _fit_in_task(sites: DataFrame, width: int, task: str, iterations: int, size: dict) -> list[Tree]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_columns(b, width) for b in batches if len(b)]
        x, n, s, margin = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort(x.T)  # sums do not follow the order of arrival
        x, n, s, margin = x[order], n[order], s[order], margin[order]
        out: list[list[bytes]] = []
        for _ in range(iterations):
            tree = _grow(lambda *a: _shaped(_count(x, n, s, margin, task, *a), a[2], width), **size)
            if len(tree[0]) == 1:
                break
            margin = margins(x, margin, [tree])
            out.append([a.tobytes() for a in tree])
        columns = [pa.array(list(c), pa.binary()) for c in zip(*out)] if out else [pa.array([], pa.binary())] * 4
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *columns], names=["round", *TREE])

    made = sites.coalesce(1).mapInArrow(run, "round int, " + ", ".join(f"{c} binary" for c in TREE)).collect()
    return [tuple(np.frombuffer(bytes(r[c]), k) for c, k in TREE.items()) for r in sorted(made, key=lambda r: r["round"])]


def _sites(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``x, n, s``: bins, rows and label sum of all rows in the same bins."""

    @F.pandas_udf("array<short>")
    def binned(xs: pd.Series) -> pd.Series:
        x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, len(edges)))
        # a value on an edge belongs to the bin below it
        codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        return pd.Series(list(codes.astype(np.int16)))

    placed = rows.select(binned("x").alias("x"), "y")
    return placed.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"))


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
    return (x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s", "margin")))


def _with_margins(sites: DataFrame, width: int, trees: list[Tree]) -> DataFrame:
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _, margin = _columns(batch, width)
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins(x, margin, trees)))

    return cut_lineage(sites.mapInArrow(move, sites.schema))


def _count(
    x: np.ndarray, n: np.ndarray, s: np.ndarray, margin: np.ndarray, task: str, tree: Tree, slots: np.ndarray, n_slots: int
) -> np.ndarray:
    """Gradient, curvature and rows per (slot, feature, bin), flat, of the nodes with a slot."""
    width = x.shape[1]
    size = n_slots * width * (BINS + 1)
    if task == "regression":
        gradient, curvature = n * margin - s, n
    else:
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = n * p - s, n * p * (1 - p)
    slot = slots[descend(x, tree[0], tree[1], tree[2])]
    here = np.flatnonzero(slot >= 0)
    place = ((slot[here, None] * width + np.arange(width)) * (BINS + 1) + x[here]).ravel()
    return np.stack([np.bincount(place, np.repeat(w[here], width), size) for w in (gradient, curvature, n)])


def _shaped(total: np.ndarray, n_slots: int, width: int) -> np.ndarray:
    return np.moveaxis(total.reshape(3, n_slots, width, BINS + 1), 0, -1)


def _histograms(
    sites: DataFrame, partitions: int, width: int, recent: list[Tree], task: str, tree: Tree, slots: np.ndarray, n_slots: int
) -> np.ndarray:
    """``(slots, features, bins, 3)`` over all sites, in one job."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((3, n_slots * width * (BINS + 1)))
        for batch in batches:
            x, n, s, margin = _columns(batch, width)
            out += _count(x, n, s, margins(x, margin, recent), task, tree, slots, n_slots)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["h"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"h": [sum(np.frombuffer(h) for h in frame["h"]).tobytes()]})

    parts = sites.mapInArrow(add, "h binary")
    if partitions > SLOTS:
        parts = parts.groupBy(F.spark_partition_id() % SLOTS).applyInPandas(merge, "h binary")
    return _shaped(sum(np.frombuffer(bytes(r["h"])) for r in parts.collect()), n_slots, width)


def _cuts(hist: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node the largest gain of any cut, its feature and bin, and what lies up to it."""
    below = hist.cumsum(axis=2)
    every = below[:, :, -1:, :]
    above = every - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below[..., 0] ** 2 / below[..., 1] + above[..., 0] ** 2 / above[..., 1] - every[..., 0] ** 2 / every[..., 1]
    enough = np.minimum(below[..., 2], above[..., 2]) >= min_leaf
    enough &= np.minimum(below[..., 1], above[..., 1]) >= LEAST_CURVATURE
    gain = np.where(enough, gain, -np.inf).reshape(len(hist), -1)
    best = gain.argmax(axis=1)
    at = np.arange(len(hist))
    return gain[at, best], best // (BINS + 1), best % (BINS + 1), below.reshape(len(hist), -1, 3)[at, best]


def _grow(count: Callable[[Tree, np.ndarray, int], np.ndarray], *, depth: int, leaves: int, min_leaf: int, rate: float) -> Tree:
    """One tree over bins.

    What growing by largest gain would cut among the nodes known so far bounds what it can cut in
    the end, as deeper nodes only compete: no other node is taken further.
    """
    feature, cut, left, gains, sums = [-1], [0], [0], [0.0], [None]
    parent: dict[int, int] = {}
    held: dict[int, np.ndarray] = {}
    wanted = [0]  # nodes that are counted; a sibling is the rest of the parent
    for d in range(depth):
        if not wanted:
            break
        slots = np.full(len(feature), -1)
        slots[wanted] = np.arange(len(wanted))
        tree = (np.array(feature), np.array(cut), np.array(left), None)
        counted = count(tree, slots, len(wanted))
        fresh = dict(zip(wanted, counted))
        for node in wanted if d else ():
            above = parent[node]
            fresh[2 * left[above] + 1 - node] = held[above] - fresh[node]
        held, nodes = fresh, sorted(fresh)
        hist = np.stack([held[node] for node in nodes])
        gain, by, at, below = _cuts(hist, min_leaf)
        wanted = []
        for i, node in enumerate(nodes):
            every = hist[i, 0].sum(axis=0)
            sums[node] = every
            if not gain[i] > 1e-12 * max(1.0, every[0] ** 2 / max(every[1], 1e-300)):
                continue
            first = len(feature)
            feature[node], cut[node], left[node], gains[node] = int(by[i]), int(at[i]), first, float(gain[i])
            parent[first] = parent[first + 1] = node
            feature += [-1, -1]
            cut += [0, 0]
            left += [0, 0]
            gains += [0.0, 0.0]
            sums += [below[i], every - below[i]]
        kept = _first_cuts(feature, left, gains, leaves)
        for node in nodes:
            if node in kept:
                wanted.append(left[node] + int(sums[left[node]][2] > sums[left[node] + 1][2]))
            else:
                feature[node] = -1
    return _kept_tree(feature, cut, left, sums, _first_cuts(feature, left, gains, leaves), rate)


def _first_cuts(feature: list, left: list, gains: list, leaves: int) -> set[int]:
    """The nodes that always cutting the leaf of largest gain cuts, up to ``leaves`` leaves."""
    kept: set[int] = set()
    waiting = [(-gains[0], 0)] if feature[0] >= 0 else []
    while waiting and len(kept) < leaves - 1:
        _, node = heapq.heappop(waiting)
        kept.add(node)
        for child in (left[node], left[node] + 1):
            if feature[child] >= 0:
                heapq.heappush(waiting, (-gains[child], child))
    return kept


def _kept_tree(feature: list, cut: list, left: list, sums: list, kept: set[int], rate: float) -> Tree:
    order, places = [0], {0: 0}
    for node in order:  # grows while it is read
        if node in kept:
            for child in (left[node], left[node] + 1):
                places[child] = len(order)
                order.append(child)
    return (
        np.array([feature[n] if n in kept else -1 for n in order], np.int16),
        np.array([cut[n] for n in order], np.float64),
        np.array([places[left[n]] if n in kept else 0 for n in order], np.int32),
        np.array([0.0 if n in kept else -rate * sums[n][0] / sums[n][1] for n in order]),
    )


def _with_values(tree: Tree, edges: list[np.ndarray]) -> Tree:
    """The same tree over values instead of bins."""
    feature, cut, left, value = tree
    values = np.array([edges[f][int(c)] if f >= 0 else 0.0 for f, c in zip(feature, cut)])
    return feature, values, left, value
