"""Density-based clustering with noise, exact, on a grid of bounded tiles."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.kernels import components, within
from gaugeflow.operators.scaling import standardize
from gaugeflow.plans.graph import connected_components
from gaugeflow.plans.ordered import order_rows, with_rank
from gaugeflow.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

PIVOTS = 3
FINER = 10  # times that the width of a cell may be halved


def dbscan(
    df: DataFrame,
    cols: Sequence[str],
    id_col: str,
    *,
    eps: float = 0.8,
    min_samples: int = 15,
    scale: bool = False,
    tile_rows: int = 1024,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Add ``is_core`` and ``label`` (-1 is noise) to ``(id, cols)``.

    Equal points are first merged into one weighted site.  Distances use all columns.  Sites
    are put into cells, no narrower than eps, over their distances to a few pivots far apart:
    by the triangle inequality two sites within eps differ by no more than eps in each of them,
    whatever the number of columns.  A full cell is cut into chunks, so one task compares two
    chunks of at most about ``tile_rows`` sites each.
    A task returns neighbour counts and the links of a spanning forest, not pairs.
    A crowded spot (a box of diagonal eps with enough points) needs no comparisons of its
    own: its points are all core and all linked.
    Clusters are numbered by their least core id; a border point takes the lowest
    cluster number among its core neighbours.
    """
    cols = list(cols)
    rows = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
    if scale:
        rows = standardize(rows, cols)
    rows = rows.withColumn("__x", F.array(*cols))
    merged = rows.groupBy(F.col("__x").alias("x")).agg(F.min(id_col).alias("pid"), F.count("*").alias("wt"))
    spotted = cut_lineage(_with_spots(merged, len(cols), eps, min_samples, tile_rows))
    placed = spotted.withColumn("at", F.array(*[_distance(F.col("x"), p) for p in _pivots(spotted, pivots)]))
    sites = cut_lineage(_with_tiles(cut_lineage(placed), pivots, eps, tile_rows))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        near = within(np.stack(left["x"]), np.stack(right["x"]), eps)
        out = [pd.DataFrame({"pid": left["pid"], "near": near @ right["wt"].to_numpy()})]
        if not same:
            out.append(pd.DataFrame({"pid": right["pid"], "near": near.T @ left["wt"].to_numpy()}))
        return pd.concat(out)

    tiles = sites.select("pid", "x", "wt", F.explode("tiles").alias("t")).select("pid", "x", "wt", "t.*")
    near = _both_sides(tiles).groupBy("lo", "hi").applyInPandas(count, "pid long, near long")
    counted = near.groupBy("pid").agg(F.sum("near").alias("near"))
    enough = F.col("spot").isNotNull() | (F.coalesce("near", F.lit(0)) >= min_samples)
    core = cut_lineage(sites.select("pid", "spot").join(counted, "pid", "left").select("pid", enough.alias("is_core")))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        near = within(np.stack(left["x"]), np.stack(right["x"]), eps)
        return _links(left, right, near, same)

    marked = tiles.join(core, "pid")
    spots = sites.filter("pid <> spot").select(F.col("pid").alias("a"), F.col("spot").alias("b"), F.lit(False).alias("border"))
    links = cut_lineage(
        _both_sides(marked).groupBy("lo", "hi").applyInPandas(link, "a long, b long, border boolean").union(spots)
    )
    comps = cut_lineage(connected_components(links.filter(~F.col("border")).select("a", "b")))
    cores = core.filter("is_core").select("pid")
    cores = cores.join(comps, cores["pid"] == comps["node"], "left").select(
        "pid", F.coalesce("component", "pid").alias("component")
    )
    numbered = with_rank(order_rows(cores.select("component").distinct(), ["component"]), "rank").result()
    cores = cores.join(numbered, "component").select("pid", (F.col("rank") - 1).cast("int").alias("label"))
    border = links.filter("border").join(cores, F.col("b") == F.col("pid")).groupBy("a").agg(F.min("label").alias("label"))
    labels = cores.union(border.select("a", "label"))
    by_site = merged.select("x", "pid").join(core, "pid").join(labels, "pid", "left")
    by_site = by_site.withColumnRenamed("x", "__x").drop("pid")
    return rows.join(by_site, "__x").select(
        id_col, *cols, "is_core", F.coalesce("label", F.lit(-1)).alias("label")
    )


def _with_spots(sites: DataFrame, dims: int, eps: float, min_samples: int, tile_rows: int) -> DataFrame:
    """Mark sites of a crowded spot with its least id; other sites have none."""
    width = eps / math.sqrt(dims) * (1 - 1e-9)
    box = F.transform("x", lambda v: F.floor(v / width))
    boxed = sites.withColumn("box", box)
    crowded = (
        boxed.groupBy("box")
        .agg(F.count("*").alias("n"), F.sum("wt").alias("w"), F.min("pid").alias("spot"))
        .filter((F.col("n") >= tile_rows) & (F.col("w") >= min_samples))
    )
    return boxed.join(crowded.select("box", "spot"), "box", "left").drop("box")


def _distance(x: Column, point: Sequence[float]) -> Column:
    """Euclidean distance of a vector column to one point."""
    gaps = F.zip_with(x, F.array(*[F.lit(float(v)) for v in point]), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g))


def _pivots(sites: DataFrame, n: int) -> list[list[float]]:
    """``n`` sites far apart: each is the farthest from those before it, the first from the origin.

    Ties go to the least id; with fewer distinct sites some pivots repeat, which prunes nothing.
    """
    first = sites.select(F.size("x").alias("d")).first()
    if first is None:
        return [[0.0]] * n
    chosen: list[list[float]] = []
    for _ in range(n):
        apart = F.least(*[_distance(F.col("x"), p) for p in chosen] * (2 if len(chosen) == 1 else 1)) if chosen else None
        apart = _distance(F.col("x"), [0.0] * first["d"]) if apart is None else apart
        chosen.append(list(sites.agg(F.max_by("x", F.struct(apart, -F.col("pid")))).first()[0]))
    return chosen


def _with_tiles(sites: DataFrame, dims: int, eps: float, tile_rows: int) -> DataFrame:
    """Sites with the tiles (pairs of chunks) they take part in, by the ``dims`` distances in ``at``.

    Cells are at least eps wide, so neighbours lie in adjoining cells; sparse data gets
    wider cells, for about ``tile_rows`` sites in each that has any. Distances are rounded:
    cells are wider by more than that.
    """
    at = [F.get("at", F.lit(d)) for d in range(dims)]
    spread = [f(a).alias(f"{name}{i}") for i, a in enumerate(at) for name, f in (("lo", F.min), ("hi", F.max))]
    spans = sites.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("length"), *spread).first()
    wanted = spans["n"] / tile_rows
    low, high = ([spans[f"{name}{d}"] or 0.0 for d in range(dims)] for name in ("lo", "hi"))
    blur = [1e-15 * (spans["length"] or 1) * h for h in high]

    def cells(per_dim: int) -> Column:
        widths = [max(eps, (high[d] - low[d]) / per_dim) * (1 + 1e-9) + blur[d] for d in range(dims)]
        return F.struct(*[F.floor((at[d] - low[d]) / widths[d]).alias(f"c{d}") for d in range(dims)])

    # where sites crowd together few cells are occupied, and narrower ones part them
    finer = [max(1, math.floor(wanted ** (1 / dims))) << k for k in range(FINER)]
    counts = sites.agg(*[F.approx_count_distinct(cells(p)).alias(f"n{k}") for k, p in enumerate(finer)]).first()
    cell = cells(next((p for k, p in enumerate(finer) if counts[f"n{k}"] >= wanted), finer[-1]))
    placed = sites.withColumn("cell", cell)
    units = placed.groupBy("cell", "spot").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("chunks"))
    offsets = [
        F.struct(*[(F.col(f"cell.c{d}") + step[d]).alias(f"c{d}") for d in range(dims)])
        for step in product((-1, 0, 1), repeat=dims)
    ]
    # at most 3^dims cells, each with its ordinary sites and its crowded spots
    held = units.groupBy("cell").agg(F.collect_list(F.struct("cell", "spot", "chunks")).alias("units"))
    around = held.select("cell", F.explode(F.array(*offsets)).alias("nb"))
    around = around.join(held.select(F.col("cell").alias("nb"), "units"), "nb")
    around = around.groupBy("cell").agg(F.flatten(F.collect_list("units")).alias("around"))
    placed = placed.join(around, "cell")

    mine = F.get(
        F.filter("around", lambda u: (u["cell"] == F.col("cell")) & u["spot"].eqNullSafe(F.col("spot"))), F.lit(0)
    )
    chunk = F.pmod(F.xxhash64("pid"), mine["chunks"]).cast("int")
    placed = placed.withColumn("own", F.struct("cell", "spot", chunk.alias("chunk")))

    def chunks_of(u: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), u["chunks"] - 1),
            lambda k: F.struct(u["cell"].alias("cell"), u["spot"].alias("spot"), k.alias("chunk")),
        )

    others = F.filter("around", lambda u: F.col("spot").isNull() | ~u["spot"].eqNullSafe(F.col("spot")))
    pairs = F.transform(
        F.flatten(F.transform(others, chunks_of)),
        lambda other: F.struct(
            F.least(F.col("own"), other).alias("lo"),
            F.greatest(F.col("own"), other).alias("hi"),
            (F.col("own") <= other).alias("left"),
        ),
    )
    return placed.select("pid", "x", "wt", "spot", pairs.alias("tiles"))


def _both_sides(tiles: DataFrame) -> DataFrame:
    """Mark the tiles that compare a chunk with itself."""
    return tiles.withColumn("same", F.col("lo") == F.col("hi"))


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    if bool(pdf["same"].iloc[0]):
        return pdf, pdf, True
    return pdf[pdf["left"]], pdf[~pdf["left"]], False


def _links(left: pd.DataFrame, right: pd.DataFrame, near: np.ndarray, same: bool) -> pd.DataFrame:
    """Core-core links as one star per connected part, and border-to-part links."""
    nodes = left if same else pd.concat([left, right])
    pid, core = nodes["pid"].to_numpy(), nodes["is_core"].to_numpy(bool)
    if same:
        linked = near
    else:
        linked = np.zeros((len(nodes), len(nodes)), bool)
        linked[: len(left), len(left) :] = near
        linked[len(left) :, : len(left)] = near.T
    part = np.full(len(nodes), -1)
    where = np.flatnonzero(core)
    part[where] = components(linked[np.ix_(where, where)])
    heads = {p: pid[where[part[where] == p]].min() for p in np.unique(part[where])}
    a, b, border = [], [], []
    for i in where:
        if pid[i] != heads[part[i]]:
            a.append(pid[i]), b.append(heads[part[i]]), border.append(False)
    for i in np.flatnonzero(~core):
        for p in np.unique(part[linked[i] & core]):
            a.append(pid[i]), b.append(heads[p]), border.append(True)
    return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64"), "border": pd.Series(border, dtype="bool")})
