"""Helpers for tasks that walk through sorted groups of rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by ``keys``, also where one spans several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        values = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            part = batch.iloc[a:b]
            if held and any(held[-1][k].iloc[-1] != part[k].iloc[0] for k in keys):
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links ``a[i] - b[i]``, enough to hold the same places together."""
    parent: dict[int, int] = {}
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = x, y
        while parent.setdefault(rx, rx) != rx:
            parent[rx] = rx = parent[parent[rx]]
        while parent.setdefault(ry, ry) != ry:
            parent[ry] = ry = parent[parent[ry]]
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out
