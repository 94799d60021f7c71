"""Small NumPy helpers that run inside one Spark task (or on a bounded matrix)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices, summed per dimension."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return np.sqrt(out)


#: Columns from which a matrix product is used, and magnitude above which its squares may overflow.
WIDE, HUGE = 8, 1e140
#: Rows of each side whose distances are held at once.
SIDE = 512


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """Squared distances by one matrix product around the mean of ``b``, and the largest sums of two squared
    norms, around that mean and as given; nothing where the product has no use or no meaning."""
    if a.shape[1] < WIDE or not len(a) or not len(b):
        return None
    if not (np.abs(a).max() < HUGE and np.abs(b).max() < HUGE):  # also where a value is missing
        return None
    centre = b.mean(axis=0)
    ac, bc = a - centre, b - centre
    na, nb, ra, rb = (np.einsum("ij,ij->i", m, m) for m in (ac, bc, a, b))
    left = np.column_stack((-2 * ac, na, np.ones(len(a))))
    right = np.column_stack((bc, np.ones(len(b)), nb))
    return left @ right.T, na.max() + nb.max(), ra.max() + rb.max() + 2 * (centre @ centre)


def _of_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances`` of some pairs of rows, summed in the same order."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        gap = a[i, d] - b[j, d]
        out += gap * gap
    return np.sqrt(out)


def fast_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances`` to about nine digits; pairs close together for the largest norms, which a product rounds
    away, are summed per dimension."""
    found = _product(a, b)
    if found is None:
        return distances(a, b)
    sq, norms, given = found
    close = sq < max(1e-5 * norms, 1e-10 * given)
    some = np.count_nonzero(close)
    if 4 * some > close.size:
        return distances(a, b)
    i, j = np.nonzero(close) if some else ([], [])
    sq[i, j] = 0.0
    np.sqrt(sq, out=sq)
    sq[i, j] = _of_pairs(a, b, i, j)
    return sq


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """``distances(a, b) <= eps``; pairs too close to the limit for a product are summed per dimension."""
    return np.concatenate([_within(a[p : p + SIDE], b, eps) for p in range(0, max(1, len(a)), SIDE)])


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    found = _product(a, b)
    if found is None:
        return distances(a, b) <= eps
    sq, norms, given = found
    limit = eps * abs(eps)
    blur = 1e-11 * given + 1e-13 * (norms + abs(limit))
    near = sq <= limit - blur
    unsure = sq <= limit + blur
    some = np.count_nonzero(unsure) - np.count_nonzero(near)
    if 4 * some > near.size:
        return distances(a, b) <= eps
    if some:
        i, j = np.nonzero(unsure & ~near)
        near[i, j] = _of_pairs(a, b, i, j) <= eps
    return near


def tile_distance_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distance sums per (row, cluster of the other side) for one tile ``(i, j)``."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = pdf[pdf["g"] == i], pdf[pdf["g"] == j]
    if not (len(left) and len(right)):
        return pd.DataFrame({"id": [], "c": [], "other": [], "d": []})
    a, b = np.stack(left["x"]), np.stack(right["x"])
    (in_left, of_left), (in_right, of_right) = _members(left), _members(right)
    sums, back = np.zeros((len(a), len(in_right))), np.zeros((len(b), len(in_left)))
    for p in range(0, len(a), SIDE):
        for q in range(0, len(b), SIDE):
            d = fast_distances(a[p : p + SIDE], b[q : q + SIDE])
            sums[p : p + SIDE] += d @ of_right[q : q + SIDE]
            if i != j:
                back[q : q + SIDE] += d.T @ of_left[p : p + SIDE]
    parts = [_sums_by_cluster(left, in_right, sums)]
    if i != j:
        parts.append(_sums_by_cluster(right, in_left, back))
    return pd.concat(parts)


def _members(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of some rows, and a row's one in the column of its own."""
    clusters, codes = np.unique(rows["c"].to_numpy(), return_inverse=True)
    member = np.zeros((len(rows), len(clusters)))
    member[np.arange(len(rows)), codes] = 1.0
    return clusters, member


def _sums_by_cluster(rows: pd.DataFrame, clusters: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "id": np.repeat(rows["id"].to_numpy(), len(clusters)),
            "c": np.repeat(rows["c"].to_numpy(), len(clusters)),
            "other": np.tile(clusters, len(rows)),
            "d": sums.ravel(),
        }
    )


def ward_labels(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Merge weighted centres by least growth of within-cluster variance until ``k`` remain."""
    centres, sizes = centres.copy(), sizes.copy()
    members = [[i] for i in range(len(centres))]
    alive = [i for i in range(len(centres)) if sizes[i] > 0]
    empty = [i for i in range(len(centres)) if sizes[i] <= 0]
    while len(alive) > k:
        m, s = centres[alive], sizes[alive]
        cost = distances(m, m) ** 2 * (s[:, None] * s[None, :]) / (s[:, None] + s[None, :])
        np.fill_diagonal(cost, np.inf)
        a, b = divmod(int(np.argmin(cost)), len(alive))
        i, j = alive[min(a, b)], alive[max(a, b)]
        total = sizes[i] + sizes[j]
        centres[i] = (centres[i] * sizes[i] + centres[j] * sizes[j]) / total
        sizes[i] = total
        members[i] += members[j]
        alive.remove(j)
    labels = np.zeros(len(members), int)
    for label, i in enumerate(alive):
        labels[members[i]] = label
    for i in empty:
        labels[i] = labels[alive[int(np.argmin(distances(centres[[i]], centres[alive])))]]
    return labels


def components(linked: np.ndarray) -> np.ndarray:
    """Component number of every node of a small symmetric boolean adjacency matrix."""
    label = np.full(len(linked), -1)
    for start in range(len(linked)):
        if label[start] >= 0:
            continue
        label[start] = start
        frontier = np.array([start])
        while len(frontier):
            reached = linked[frontier].any(axis=0) & (label < 0)
            frontier = np.flatnonzero(reached)
            label[frontier] = start
    return label
