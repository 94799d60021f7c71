"""Synchronous gradient descent: one optimiser state, gradients of all tasks summed in a tree per step."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Vectors that one task, or the driver, adds up.
SLOTS = 32

#: ``(weights, rows)`` to the summed gradient, the summed loss and the number of rows.
Gradient = Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, float, int]]


@dataclass
class Adam:
    """The optimiser's state; ``move`` takes the mean gradient of a step."""

    rate: float
    first: float = 0.9
    second: float = 0.999
    steps: int = 0
    m: np.ndarray | float = field(default=0.0)
    v: np.ndarray | float = field(default=0.0)

    def move(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient * gradient
        size = self.rate * np.sqrt(1 - self.second**self.steps) / (1 - self.first**self.steps)
        return weights - size * self.m / (np.sqrt(self.v) + 1e-8)


def summed_gradient(
    rows: DataFrame, gradient: Gradient, weights: np.ndarray, size: int | None = None
) -> tuple[np.ndarray, float, int]:
    """``gradient`` over all of ``rows``: tasks add up their batches, and no task nor the driver adds
    more than ``SLOTS`` vectors. No rows give zeros. Other sums than gradients may have a ``size``
    that is not that of the weights."""
    size = len(weights) if size is None else size

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros(size), 0.0, 0
        for frame in frames:
            if len(frame):
                g, some, count = gradient(weights, frame)
                total, loss, n = total + g, loss + some, n + count
        if n:
            slot = TaskContext.get().partitionId()
            yield pd.DataFrame({"slot": [slot], "n": [n], "loss": [loss], "g": [total.tobytes()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g) for g in frame["g"])
        return pd.DataFrame(
            {"slot": frame["slot"].iloc[:1], "n": [frame["n"].sum()], "loss": [frame["loss"].sum()], "g": [total.tobytes()]}
        )

    schema = "slot int, n long, loss double, g binary"
    parts, vectors = rows.mapInPandas(part, schema), rows.rdd.getNumPartitions()
    while vectors > SLOTS:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / SLOTS).cast("int"))
        parts, vectors = parts.groupBy("slot").applyInPandas(merge, schema), -(-vectors // SLOTS)
    got = sorted(parts.collect(), key=lambda r: r["slot"])  # the same sum whatever task ends first
    total = sum((np.frombuffer(bytes(r["g"])) for r in got), np.zeros(size))
    return total, float(sum(r["loss"] for r in got)), sum(r["n"] for r in got)
