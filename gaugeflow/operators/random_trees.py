"""Forests. Extremely random trees: every node of every tree draws its own cut of every feature.
Bagged trees: every tree has a bootstrap of the rows, and a node takes the best cut between bins.

Rows that are equal in all features become one weighted site first, which loses nothing. All
trees of a group grow together, level by level: one job routes the sites to the open nodes and
adds up what lies on each side of each drawn cut, for all (tree, node, feature) at once. A node
with ``LOCAL_ROWS`` sites or fewer leaves the levels; the sites below it go to one task, which
grows the rest of its subtree by the same rule. Draws are hashes of (seed, tree, node, feature),
so they follow neither the partitions nor the place where a node is grown.

Bagged trees cut between at most ``BINS`` bins per feature, so rows of equal bins and label are one
site, and the bootstrap draws how often it counts: so many independent Poisson draws as it has rows.

The trees are a table, one row each: neither the driver nor a task holds a large forest whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.scaling import busy_partitions
from gaugeflow.plans import defaults
from gaugeflow.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Distinct rows below which one task grows the rest of a subtree.
LOCAL_ROWS = 65_536
#: Bytes of counts that one task, or the driver, holds for the trees that grow together.
LEVEL_BYTES = 32 << 20
#: Bytes of trees that are sent to every task; of larger forests a task scores with so many at a time.
SENT_BYTES = 32 << 20
#: Bytes of distinct rows that one task scores with a part of a larger forest.
BLOCK_BYTES = 8 << 20
#: Bins per feature of bagged trees, and bytes of counts that a task holds at once while it grows one.
BINS, COUNT_BYTES = 32, 8 << 20
#: Rows of a site above which its bootstrap is drawn from the normal expansion of its Poisson law.
MANY_ROWS = 100

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def draws(seed: int, tree: int, codes: np.ndarray, width: int, kind: int) -> np.ndarray:
    """A number in [0, 1) for each (node, feature) of a tree; ``kind`` parts cuts from orders."""
    start = _mix(np.array([seed, tree, kind], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    key = _mix(codes.astype(np.uint64) ^ start[0] ^ (start[1] << np.uint64(1)) ^ (start[2] << np.uint64(2)))
    step = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return (_mix(key[:, None] + step[None, :]) >> np.uint64(11)) * 2.0**-53


@dataclass(frozen=True)
class Rule:
    """How nodes are cut."""

    width: int
    tried: int
    min_leaf: int
    depth: int
    seed: int
    cut_type = np.float32

    @property
    def counted(self) -> int:
        """Numbers that are counted per node."""
        return 4 + 5 * self.width

    def cuts(self, tree: int, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        drawn = low + draws(self.seed, tree, codes, self.width, 0) * (high - low)
        return np.maximum(np.minimum(drawn, high), low).astype(np.float32).astype(float)

    def count(self, x: np.ndarray, w: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Per node: rows, sums and square sums (``w``), then per feature the rows and sums up to
        the cut, the least and the largest value, the sites up to the cut, and all sites."""
        k, f = len(cuts), self.width
        out = np.zeros((k, self.counted))
        for i in range(3):
            out[:, i] = np.bincount(node, w[:, i], k)
        below = x <= cuts[node]
        for j in range(f):
            at = np.flatnonzero(below[:, j])
            out[:, 3 + j] = np.bincount(node[at], w[at, 0], k)
            out[:, 3 + f + j] = np.bincount(node[at], w[at, 1], k)
            out[:, 3 + 4 * f + j] = np.bincount(node[at], minlength=k)
        out[:, -1] = np.bincount(node, minlength=k)
        out[:, 3 + 2 * f : 3 + 3 * f], out[:, 3 + 3 * f : 3 + 4 * f] = np.inf, -np.inf
        if len(node):
            order = np.argsort(node, kind="stable")
            some, first = np.unique(node[order], return_index=True)
            sorted_x = x[order]
            out[some, 3 + 2 * f : 3 + 3 * f] = np.minimum.reduceat(sorted_x, first)
            out[some, 3 + 3 * f : 3 + 4 * f] = np.maximum.reduceat(sorted_x, first)
        return out

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high, end = (3 + i * self.width for i in (2, 3, 4))
        least, most = np.minimum(a[:, low:high], b[:, low:high]), np.maximum(a[:, high:end], b[:, high:end])
        return np.hstack((a[:, :low] + b[:, :low], least, most, a[:, end:] + b[:, end:]))

    def weigh(self, tree: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The rows of each site that a tree learns from: all."""
        return w

    def resolve(self, counts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What lies on each side of the cut of every (node, feature), and the cuts."""
        return counts, cuts

    def measure(self, x: np.ndarray, w: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.resolve(self.count(x, w, node, cuts), cuts)

    def choose(self, tree: int, codes: np.ndarray, level: int, counts: np.ndarray) -> np.ndarray:
        """The feature that each node is cut by, or -1 for a leaf: of the first ``tried`` features in
        drawn order whose cut leaves ``min_leaf`` rows on both sides, the one that lowers the
        squared error most."""
        f = self.width
        n, s, q = counts[:, 0], counts[:, 1], counts[:, 2]
        nl, sl = counts[:, 3 : 3 + f], counts[:, 3 + f : 3 + 2 * f]
        nr, sr = n[:, None] - nl, s[:, None] - sl
        valid = (nl >= self.min_leaf) & (nr >= self.min_leaf)
        order = np.argsort(draws(self.seed, tree, codes, f, 1), axis=1)
        rank = np.cumsum(np.take_along_axis(valid, order, axis=1), axis=1)
        allowed = np.zeros_like(valid)
        np.put_along_axis(allowed, order, rank <= self.tried, axis=1)
        gain = np.where(valid & allowed, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1), -np.inf)
        best = gain.argmax(axis=1)
        pure = n * q - s * s <= 1e-12 * np.maximum(n * q, 1e-300)
        leaf = pure | ~np.isfinite(gain.max(axis=1)) | (level >= self.depth)
        return np.where(leaf, -1, best)


def poisson(mean: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A Poisson number of each mean, from two numbers in [0, 1): by the inverse of its distribution, and
    above ``MANY_ROWS`` by its normal expansion (Cornish-Fisher to the term of the skewness)."""
    out = np.zeros(len(mean))
    few = np.flatnonzero(mean <= MANY_ROWS)
    m, at, k = mean[few], u[few], 0
    p = np.exp(-m)
    upto = p.copy()
    while len(few) and k < 20 * MANY_ROWS:
        more = at >= upto
        few, m, at, p, upto = few[more], m[more], at[more], p[more], upto[more]
        k += 1
        out[few] = k
        p = p * m / k
        upto = upto + p
        ended = p < 1e-300  # the sum no longer grows
        few, m, at, p, upto = (a[~ended] for a in (few, m, at, p, upto))
    many = np.flatnonzero(mean > MANY_ROWS)
    z = np.sqrt(-2 * np.log1p(-u[many])) * np.cos(2 * np.pi * v[many])
    out[many] = np.maximum(np.floor(mean[many] + np.sqrt(mean[many]) * z + (z * z - 1) / 6 + 0.5), 0)
    return out


@dataclass(frozen=True)
class BaggedRule(Rule):
    """Best cuts between bins, on a bootstrap of the rows. A node's counts are its rows, sums and square
    sums, then the rows, sums and sites of each bin of each feature, and all its sites."""

    edges: tuple[np.ndarray, ...] = ()
    cut_type = np.float64

    @property
    def bins(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]

    @property
    def counted(self) -> int:
        return 4 + 3 * sum(self.bins)

    def cuts(self, tree: int, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.zeros((len(codes), self.width))  # found with the counts

    def weigh(self, tree: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Drawn by what a site is, so that it has the same rows on every level and in every task."""
        start = np.array([self.seed, tree, 2], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        key = np.full(len(x), _mix(_mix(start[:1]) ^ start[1:2] ^ (start[2:] << np.uint64(32)))[0])
        for column in (*x.T, w[:, 1] / w[:, 0]):
            key = _mix(key ^ (np.ascontiguousarray(column) + 0.0).view(np.uint64)) + np.uint64(0xD1B54A32D192ED03)
        u, v = ((_mix(key + np.uint64(i)) >> np.uint64(11)) * 2.0**-53 for i in (1, 2))
        return w * (poisson(w[:, 0], u, v) / w[:, 0])[:, None]

    def count(self, x: np.ndarray, w: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        k, at = len(cuts), 3
        out = np.zeros((k, self.counted))
        for i in range(3):
            out[:, i] = np.bincount(node, w[:, i], k)
        for j, bins in enumerate(self.bins):
            place = node * bins + np.searchsorted(self.edges[j], x[:, j], side="left")
            for weight in (w[:, 0], w[:, 1], None):
                out[:, at : at + bins] = np.bincount(place, weight, k * bins).reshape(k, bins)
                at += bins
        out[:, -1] = np.bincount(node, minlength=k)
        return out

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def resolve(self, counts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best cut of each (node, feature) that leaves ``min_leaf`` rows on both sides, as ``Rule`` counts it."""
        f, at, each = self.width, 3, np.arange(len(counts))
        out, found = np.zeros((len(counts), 4 + 5 * f)), np.zeros((len(counts), f))
        out[:, :3], out[:, -1] = counts[:, :3], counts[:, -1]
        n, s = counts[:, :1], counts[:, 1:2]
        for j, bins in enumerate(self.bins):
            nl, sl, sites = (np.cumsum(counts[:, at + i * bins : at + (i + 1) * bins - 1], axis=1) for i in range(3))
            at += 3 * bins
            if bins == 1:
                continue
            nr, sr = n - nl, s - sl
            valid = (nl >= self.min_leaf) & (nr >= self.min_leaf)
            gain = np.where(valid, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1), -np.inf)
            best = gain.argmax(axis=1)
            out[:, 3 + j], out[:, 3 + f + j], out[:, 3 + 4 * f + j] = nl[each, best], sl[each, best], sites[each, best]
            found[:, j] = self.edges[j][best]
        return out, found

    def measure(self, x: np.ndarray, w: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """So many nodes at a time as ``COUNT_BYTES`` has room for."""
        order = np.argsort(node, kind="stable")
        x, w, node = x[order], w[order], node[order]
        step, parts = max(1, COUNT_BYTES // (8 * self.counted)), []
        for first in range(0, len(cuts), step):
            some = cuts[first : first + step]
            a, b = np.searchsorted(node, (first, first + len(some)))
            parts.append(self.resolve(self.count(x[a:b], w[a:b], node[a:b] - first, some), some))
        return tuple(np.concatenate(p) for p in zip(*parts))


class Growing:
    """One tree as flat arrays; open nodes wait for their cut."""

    def __init__(self, code: int, level: int, low: np.ndarray, high: np.ndarray, cut_type: type):
        self.feature, self.cut = np.array([-1], np.int16), np.array([0.0], cut_type)
        self.left, self.value = np.array([0], np.int32), np.array([0.0])
        self.level = level
        self.open = np.array([0])  # places of the open nodes
        self.codes, self.low, self.high = np.array([code], np.int64), low[None, :], high[None, :]
        self.rows = np.array([np.inf])

    def grow(self, rule: Rule, tree: int, counts: np.ndarray, cuts: np.ndarray) -> None:
        """Close the open nodes; children of those that are cut open the next level.

        A child's range is its parent's, ended by the cut; the parent's is what its rows showed.
        """
        chosen = rule.choose(tree, self.codes, self.level, counts)
        f = rule.width
        at = np.arange(len(chosen))
        self.value[self.open] = counts[:, 1] / np.maximum(counts[:, 0], 1)
        split = np.flatnonzero(chosen >= 0)
        feature, place, cut = chosen[split], self.open[split], cuts[at[split], chosen[split]]
        n_left = counts[split, 3 + 4 * f + feature]  # sites
        low, high = counts[split, 3 + 2 * f : 3 + 3 * f], counts[split, 3 + 3 * f : 3 + 4 * f]
        first = len(self.feature) + 2 * np.arange(len(split))
        self.feature[place], self.cut[place], self.left[place] = feature, cut, first
        lows, highs = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
        each = np.arange(len(split))
        highs[2 * each, feature], lows[2 * each + 1, feature] = cut, cut
        made = 2 * len(split)
        self.feature = np.concatenate((self.feature, np.full(made, -1, np.int16)))
        self.cut = np.concatenate((self.cut, np.zeros(made, self.cut.dtype)))
        self.left = np.concatenate((self.left, np.zeros(made, np.int32)))
        self.value = np.concatenate((self.value, np.zeros(made)))
        self.rows = np.column_stack((n_left, counts[split, -1] - n_left)).ravel()
        codes = self.codes[split]
        self.codes = np.column_stack((2 * codes, 2 * codes + 1)).ravel()
        self.open, self.low, self.high = np.arange(len(self.feature) - made, len(self.feature)), lows, highs
        self.level += 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.cut, self.left, self.value


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place in a tree where each row ends."""
    at = np.zeros(len(x), dtype=np.int64)
    going = np.arange(len(x)) if feature[0] >= 0 else np.arange(0)
    while len(going):
        node = at[going]
        right = x[going, feature[node]] > cut[node]
        at[going] = node = left[node] + right
        going = going[feature[node] >= 0]
    return at


def _subtree(rule: Rule, tree: int, root: Growing, x: np.ndarray, w: np.ndarray) -> Growing:
    """Grow a whole subtree from the sites below its root."""
    node = np.zeros(len(x), dtype=np.int64)
    while len(root.open):
        cuts = rule.cuts(tree, root.codes, root.low, root.high)
        first = root.open[0]
        root.grow(rule, tree, *rule.measure(x, w, node, cuts))
        place = node + first
        cut = root.feature[place] >= 0
        x, w, place = x[cut], w[cut], place[cut]
        node = root.left[place] + (x[np.arange(len(x)), root.feature[place]] > root.cut[place]) - (root.open[0] if len(root.open) else 0)
    return root


NAMES = ("feature", "cut", "left", "value")
TREES = "tree int, " + ", ".join(f"{c} binary" for c in NAMES)


def _missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def _no_null(x: Column) -> Column:
    """Missing features as NaN, which pandas and Arrow make of them and back."""
    return F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan"))))


def _unpacked(row) -> tuple[np.ndarray, ...]:
    """The arrays of a row of trees; cuts have four or eight bytes."""
    feature = np.frombuffer(row["feature"], np.int16)
    cut = np.frombuffer(row["cut"], f"f{len(row['cut']) // len(feature)}")
    return feature, cut, np.frombuffer(row["left"], np.int32), np.frombuffer(row["value"])


@dataclass
class RandomForest:
    """A fitted forest; ``transform`` adds ``prediction`` (and ``score`` for classes).

    ``table`` has one row per tree, of ``n_trees`` in all. A ``strict`` forest does not score rows with a
    missing feature: they are an error.
    """

    features: tuple[str, ...]
    task: str
    table: DataFrame
    n_trees: int
    n_bytes: int
    strict: bool = False

    @staticmethod
    def of(features: Sequence[str], task: str, table: DataFrame, strict: bool = False) -> RandomForest:
        size = sum((F.octet_length(c) for c in NAMES), F.lit(0))
        found = table.agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
        return RandomForest(tuple(features), task, table, found["n"], found["size"], strict)

    @property
    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """All trees on the driver: for forests of few or small ones."""
        return [_unpacked(r) for r in self.table.orderBy("tree").collect()]

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        if self.strict:
            x = F.when(F.exists(x, _missing), F.raise_error(F.lit("a row to score lacks a feature"))).otherwise(x)
        if self.n_bytes <= SENT_BYTES:
            out = df.withColumn("prediction", self._mean_of_sent(x))
        else:
            df = cut_lineage(df.withColumn("__x", _no_null(x)))  # read twice, so its rows must not change
            out = df.join(self._means(df.select("__x").distinct()), "__x", "left").drop("__x")
        if self.task == "regression":
            return out
        return out.withColumnRenamed("prediction", "score").withColumn("prediction", (F.col("score") > 0.5).cast("double"))

    def _mean_of_sent(self, x: Column) -> Column:
        sent, width = self.table.sparkSession.sparkContext.broadcast(self.trees), len(self.features)

        @F.pandas_udf(T.DoubleType())
        def mean(xs: pd.Series) -> pd.Series:
            rows = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, width))
            total = np.zeros(len(rows))
            for feature, cut, left, value in sent.value:
                total += value[descend(rows, feature, cut, left)]
            return pd.Series(total / len(sent.value))

        return mean(x)

    def _means(self, keys: DataFrame) -> DataFrame:
        """Scores of distinct rows under a large forest: a task has a block of rows and a part of the trees."""
        width, n_trees = len(self.features), self.n_trees
        parts = min(n_trees, -(-self.n_bytes // SENT_BYTES))
        most = max(1, BLOCK_BYTES // (8 * width))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows, made = [], 0, TaskContext.get().partitionId() << 32

            def block() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array([made], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["block", "xs"]
                )

            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for start in range(0, len(x), most):
                    piece = x[start : start + most]
                    if held and rows + len(piece) > most:
                        yield block()
                        held, rows, made = [], 0, made + 1
                    held.append(piece.tobytes())
                    rows += len(piece)
            if held:
                yield block()

        def add(key: tuple, blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            out = blocks[["block", "part", "xs"]].copy()
            x = np.frombuffer(blocks["xs"].iloc[0]).reshape(-1, width)
            total = np.zeros(len(x))
            for _, row in trees.sort_values("tree").iterrows():
                feature, cut, left, value = _unpacked(row)
                total += value[descend(x, feature, cut, left)]
            if key[1]:
                out["xs"] = None  # one part of the trees brings the rows along
            return out.assign(total=[total.tobytes()])

        def join(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("part")
            total = sum(np.frombuffer(b) for b in frame["total"])
            x = np.frombuffer(frame["xs"].iloc[0]).reshape(-1, width)
            return pd.DataFrame({"__x": list(x), "prediction": total / n_trees})

        blocks = cut_lineage(keys.mapInArrow(pack, "block long, xs binary"))
        numbers = F.sequence(F.lit(0), F.lit(parts - 1))
        dealt = blocks.withColumn("part", F.explode(numbers))
        share = F.floor(F.col("tree") * parts / n_trees).cast("int")
        trees = self.table.withColumn("part", share).crossJoin(blocks.select(F.col("block").alias("of")))
        added = dealt.groupBy("block", "part").cogroup(trees.groupBy("of", "part"))
        added = added.applyInPandas(add, "block long, part int, xs binary, total binary")
        scores = added.groupBy("block").applyInPandas(join, "__x array<double>, prediction double")
        return cut_lineage(scores.withColumn("__x", _no_null(F.col("__x"))))

    def save(self, spark, path: str) -> None:
        """One row per tree, and one that says what the trees are of."""
        named = (list(self.features), self.task, self.strict)
        head = spark.createDataFrame([named], "features array<string>, task string, strict boolean")
        head.write.mode("overwrite").parquet(f"{path}/forest")
        self.table.write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark, path: str) -> RandomForest:
        head = spark.read.parquet(f"{path}/forest").first().asDict()
        return RandomForest.of(head["features"], head["task"], spark.read.parquet(f"{path}/trees"), head.get("strict", False))


def fit_random_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    task: str = "regression",
    trees: int = 300,
    depth: int = 16,
    min_leaf: int = 2,
    seed: int = defaults.SEED,
) -> RandomForest:
    """Fit on all rows without a missing feature or label, without bootstrap.

    Regression tries all features at a node, classification a square root of them; a 0/1 label's
    leaf mean is the class-1 probability, and squared error ranks its cuts as Gini impurity does.
    No rows at all is an error. A forest has at most ``trees * 2 ** (depth + 1)`` nodes of 18 bytes.
    """
    features = tuple(features)
    width = len(features)
    y = F.col(label).cast("double")
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = train.select(x.alias("x"), y.alias("y")).filter(F.col("y").isNotNull() & ~F.exists("x", _missing))
    sites = rows.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    sites = cut_lineage(sites)
    ends = [f(F.get("x", F.lit(j))).alias(f"{name}{j}") for j in range(width) for name, f in (("lo", F.min), ("hi", F.max))]
    span = sites.agg(F.count("*").alias("sites"), *ends).first()
    if not span["sites"]:
        raise ValueError("cannot fit trees without rows")
    low, high = (np.array([span[f"{name}{j}"] for j in range(width)]) for name in ("lo", "hi"))
    tried = width if task == "regression" else max(1, int(width**0.5))
    rule = Rule(width, tried, min_leaf, depth, seed)
    return RandomForest.of(features, task, grow_forest(sites, rule, trees, low, high, span["sites"]))


def bin_edges(rows: DataFrame, width: int, bins: int = 255) -> list[np.ndarray]:
    """Per feature of ``x`` the edges between bins: midpoints of the values where there are no more
    than ``bins``, otherwise quantiles."""
    at = [F.get("x", F.lit(j)) for j in range(width)]
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(
        *[F.approx_count_distinct(a, 0.02).alias(f"n{j}") for j, a in enumerate(at)],
        *[F.percentile_approx(a, shares, 100 * bins).alias(f"q{j}") for j, a in enumerate(at)],
    ).first()
    out = []
    for j, a in enumerate(at):
        edges = np.unique(found[f"q{j}"] or [])
        if found[f"n{j}"] <= 1.1 * bins:
            values = np.array(sorted(r[0] for r in rows.select(a).distinct().limit(bins + 1).collect()))
            if len(values) <= bins:
                edges = (values[1:] + values[:-1]) / 2
        out.append(edges)
    return out


def fit_bagged_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    task: str = "regression",
    trees: int = 200,
    depth: int = 15,
    min_leaf: int = 2,
    seed: int = defaults.SEED,
) -> RandomForest:
    """Fit on all rows, a bootstrap of them per tree; a missing feature or label is an error.

    Regression tries all features at a node, classification a square root of them, of a 0/1 label. Cuts
    lie between values, or between quantiles of features with more than ``BINS`` values.
    """
    features = tuple(features)
    width = len(features)
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = train.select(x.alias("x"), F.col(label).cast("double").alias("y"))
    whole = cut_lineage(rows.groupBy("x", "y").agg(F.count("*").alias("n")))
    lacking = F.exists("x", _missing) | _missing(F.col("y"))
    found = whole.agg(F.count("*").alias("sites"), F.count_if(lacking).alias("lacking")).first()
    if not found["sites"]:
        raise ValueError("cannot fit trees without rows")
    if found["lacking"]:
        raise ValueError("cannot fit trees on rows without a feature or label")
    edges = tuple(np.asarray(e, dtype=float) for e in bin_edges(rows, width, BINS))

    def binned(j: int) -> Column:
        """The upper end of a value's bin, by which it falls to the same side of every cut."""
        v = F.get("x", F.lit(j))
        ends = F.filter(F.array(*map(F.lit, edges[j].tolist())).cast("array<double>"), lambda e: e >= v)
        return F.coalesce(F.get(ends, F.lit(0)), F.lit(float("inf")))

    sites = whole.groupBy(F.array(*map(binned, range(width))).alias("x"), "y").agg(F.sum("n").cast("double").alias("n"))
    sites = cut_lineage(sites.select("x", "n", (F.col("n") * F.col("y")).alias("s"), (F.col("n") * F.col("y") * F.col("y")).alias("q")))
    tried = width if task == "regression" else max(1, int(width**0.5))
    rule = BaggedRule(width, tried, min_leaf, depth, seed, edges)
    none = np.zeros(width)
    return RandomForest.of(features, task, grow_forest(sites, rule, trees, none, none, sites.count()), strict=True)


def grow_forest(sites: DataFrame, rule: Rule, trees: int, low: np.ndarray, high: np.ndarray, n_sites: int) -> DataFrame:
    """A table of ``trees`` trees over ``sites`` (``x``, rows ``n``, sums ``s``, square sums ``q``)."""
    widest = min(2**rule.depth, n_sites // LOCAL_ROWS + 1)
    group = max(1, min(trees, int(LEVEL_BYTES // (widest * rule.counted * 8))))
    grown = []
    sites = busy_partitions(sites).persist()
    try:
        for start in range(0, trees, group):
            numbers = range(start, min(start + group, trees))
            grown.append(cut_lineage(_grow_group(sites, rule, numbers, low, high, n_sites)))
    finally:
        sites.unpersist()
    return reduce(DataFrame.union, grown)


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s", "q")])


def _grow_group(sites: DataFrame, rule: Rule, numbers: range, low: np.ndarray, high: np.ndarray, n_sites: int) -> DataFrame:
    growing = {t: Growing(1, 0, low, high, rule.cut_type) for t in numbers}
    roots: dict[int, list[tuple]] = {t: [] for t in numbers}  # places whose subtrees one task grows
    for t in numbers:
        growing[t].rows = np.array([n_sites])
    while True:
        for t, g in growing.items():
            small = g.rows <= LOCAL_ROWS
            roots[t] += list(zip(g.open[small], g.codes[small], [g.level] * int(small.sum()), g.low[small], g.high[small]))
            g.open, g.codes, g.low, g.high, g.rows = (a[~small] for a in (g.open, g.codes, g.low, g.high, g.rows))
        busy = {t: g for t, g in growing.items() if len(g.open)}
        if not busy:
            break
        cuts = {t: rule.cuts(t, g.codes, g.low, g.high) for t, g in busy.items()}
        counts = _level_counts(sites, rule, busy, cuts)
        for t, g in busy.items():
            g.grow(rule, t, *rule.resolve(counts[t], cuts[t]))
    return _grow_small(sites, rule, growing, roots)


def _level_counts(sites: DataFrame, rule: Rule, busy: dict[int, Growing], cuts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One job: what lies on each side of every cut of every open node."""
    sent = sites.sparkSession.sparkContext.broadcast({t: (g.feature, g.cut, g.left, g.open, cuts[t]) for t, g in busy.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x, w = _matrix(batch, rule.width)
            for t, (feature, cut, left, places, tree_cuts) in sent.value.items():
                slot = np.full(len(feature), -1)
                slot[places] = np.arange(len(places))
                node = slot[descend(x, feature, cut, left)]
                here = node >= 0
                xs = x[here]
                found = rule.count(xs, rule.weigh(t, xs, w[here]), node[here], tree_cuts)
                held[t] = rule.merge(held[t], found) if t in held else found
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([a.tobytes() for a in held.values()], pa.binary())], names=["tree", "counts"]
            )

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in frame["counts"]:
            one = np.frombuffer(b).reshape(-1, rule.counted)
            total = one if total is None else rule.merge(total, one)
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "counts": [total.tobytes()]})

    kinds = "tree int, counts binary"
    rows = sites.mapInArrow(count, kinds).groupBy("tree").applyInPandas(merge, kinds).collect()
    return {r["tree"]: np.frombuffer(r["counts"]).reshape(-1, rule.counted) for r in rows}


def _grow_small(sites: DataFrame, rule: Rule, growing: dict[int, Growing], roots: dict[int, list[tuple]]) -> DataFrame:
    """Send the sites below each small node to one task that grows its subtree; a task per tree joins them."""
    trees = {t: (growing[t].feature, growing[t].cut, growing[t].left, roots[t]) for t in growing if roots[t]}
    sent = sites.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, w = _matrix(batch, rule.width)
            both = np.hstack((x, w))
            for t, (feature, cut, left, below) in sent.value.items():
                slot = np.full(len(feature), -1)
                slot[[r[0] for r in below]] = np.arange(len(below))
                node = slot[descend(x, feature, cut, left)]
                order = np.argsort(node, kind="stable")
                order = order[np.searchsorted(node[order], 0) :]
                some, first = np.unique(node[order], return_index=True)
                parts = [both[p].tobytes() for p in np.split(order, first[1:])] if len(some) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(parts, pa.binary())],
                    names=["tree", "root", "sites"],
                )

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        t, k = int(frame["tree"].iloc[0]), int(frame["root"].iloc[0])
        _, code, level, low, high = sent.value[t][3][k]
        # in the order of the values, so that sums do not follow the partitions
        both = np.concatenate([np.frombuffer(b).reshape(-1, rule.width + 3) for b in frame["sites"]])
        both = both[np.lexsort(both.T[::-1])]
        x, w = both[:, : rule.width], both[:, rule.width :]
        made = _subtree(rule, t, Growing(code, level, low, high, rule.cut_type), x, rule.weigh(t, x, w)).arrays()
        return pd.DataFrame({"tree": [t], "root": [k], **{c: [a.tobytes()] for c, a in zip(NAMES, made)}})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("root")  # the top of the tree is first
        t = int(frame["tree"].iloc[0])
        parts = [[a.copy()] for a in _unpacked(frame.iloc[0])]
        size = len(parts[0][0])
        for _, row in frame.iloc[1:].iterrows():
            feature, cut, left, value = _unpacked(row)
            place = sent.value[t][3][row["root"]][0]
            # the subtree's root takes the place of the node; its other nodes are added at the end
            for part, a in zip(parts, (feature, cut, left + np.int32(size - 1), value)):
                part[0][place] = a[0]
                part.append(a[1:])
            size += len(feature) - 1
        return pd.DataFrame({"tree": [t], **{c: [np.concatenate(part).tobytes()] for c, part in zip(NAMES, parts)}})

    kinds = TREES.replace("tree int,", "tree int, root int,")
    tops = [(t, -1, *(a.tobytes() for a in g.arrays())) for t, g in growing.items()]
    pieces = sites.sparkSession.createDataFrame(tops, kinds)
    if trees:
        dealt = sites.mapInArrow(deal, "tree int, root int, sites binary")
        pieces = pieces.union(dealt.groupBy("tree", "root").applyInPandas(build, kinds))
    return pieces.groupBy("tree").applyInPandas(join, TREES)
