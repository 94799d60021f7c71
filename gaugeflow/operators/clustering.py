"""Centroid, mixture and hierarchical clustering, their quality measures and a 2-D view."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.kernels import tile_distance_sums, ward_labels
from gaugeflow.operators.describe import cluster_counts
from gaugeflow.operators.mixture import Clusters, fit_centres, fit_mixture
from gaugeflow.operators.scaling import busy_partitions, scaler_stage, standardize
from gaugeflow.plans import defaults
from gaugeflow.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package


def _scaled(df: DataFrame, cols: Sequence[str]) -> list:
    vector = VectorAssembler(inputCols=[f"z_{c}" for c in cols], outputCol="features")
    return [scaler_stage(df, cols), vector]


def fit_kmeans(
    df: DataFrame,
    cols: Sequence[str],
    *,
    k: int = 4,
    restarts: int = 10,
    max_iter: int = 300,
    seed: int = defaults.SEED,
) -> Clusters:
    """The best of ``restarts`` k-means fits, which share every pass over the rows."""
    return fit_centres(df, cols, k, restarts, max_iter, seed)


def fit_gmm(
    df: DataFrame,
    cols: Sequence[str],
    *,
    k: int = 4,
    restarts: int = 5,
    max_iter: int = 100,
    tol: float = 1e-3,
    ridge: float = 1e-6,
    seed: int = defaults.SEED,
) -> Clusters:
    """Full-covariance Gaussian mixture, see ``mixture``."""
    return fit_mixture(df, cols, k, restarts, max_iter, tol, ridge, seed)


def fit_hierarchical(
    df: DataFrame,
    cols: Sequence[str],
    *,
    k: int = 4,
    micro: int = 200,
    max_iter: int = 20,
    seed: int = defaults.SEED,
) -> PipelineModel:
    """Ward clusters in two stages.

    Rows become at most ``micro`` weighted centres on Spark; only those centres are
    merged by Ward's criterion, and rows inherit the cluster of their centre.
    """
    prepare = PipelineModel(_scaled(df, cols))
    ready = busy_partitions(cut_lineage(prepare.transform(df).select("features"))).persist()
    try:
        fitted = KMeans(k=micro, maxIter=max_iter, seed=seed, predictionCol="micro").fit(ready)
    finally:
        ready.unpersist()
    labels = ward_labels(np.array(fitted.clusterCenters()), np.array(fitted.summary.clusterSizes, float), k)
    entries = ", ".join(str(int(x)) for x in labels)
    merge = SQLTransformer(statement=f"SELECT *, element_at(array({entries}), micro + 1) AS prediction FROM __THIS__")
    return PipelineModel([*prepare.stages, fitted, merge])


def project_2d(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Two principal components of the scaled columns, for viewing."""
    model = Pipeline(stages=[*_scaled(df, cols), PCA(k=2, inputCol="features", outputCol="view")]).fit(df)
    view = vector_to_array("view")
    return model.transform(df).select(*keep, view[0].alias("x"), view[1].alias("y"))


# ---------------------------------------------------------------- quality

#: Groups of rows that keep a cluster busy: beyond them groups grow, to ``MOST_ROWS`` rows each, as every
#: row is sent once per group and has a sum per cluster from each.
GROUPS, MOST_ROWS = 32, 16_384


def _vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def silhouette_sq(df: DataFrame, cluster_col: str, cols: Sequence[str]) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, in linear time.

    The mean squared distance from a row to a cluster follows from the cluster's size,
    vector sum and sum of squared norms, so no pairs of rows are formed.
    """
    c = F.col(cluster_col)
    norms = sum((F.col(x).cast("double") * F.col(x) for x in cols), F.lit(0.0))
    per = df.groupBy(c.alias("c")).agg(
        F.count("*").alias("n"), F.sum(norms).alias("q"), F.array(*[F.sum(F.col(x).cast("double")) for x in cols]).alias("s")
    )
    clusters = per.agg(F.collect_list(F.struct("c", "n", "q", "s"))).scalar()
    rows = df.select(c.alias("c"), _vector(cols).alias("x"), norms.alias("xx"), clusters.alias("every"))

    def total(g: Column) -> Column:
        return g["n"] * F.col("xx") - 2 * _dot(F.col("x"), g["s"]) + g["q"]

    own = F.element_at(F.filter("every", lambda g: g["c"] == F.col("c")), 1)
    others = F.transform(F.filter("every", lambda g: g["c"] != F.col("c")), lambda g: total(g) / g["n"])
    rows = rows.withColumns({"own": own, "b": F.array_min(others)})
    a = total(F.col("own")) / (F.col("own.n") - 1)
    rows = rows.withColumn("a", F.when(F.col("own.n") > 1, F.greatest(a, F.lit(0.0))))
    return _mean_silhouette(rows)


def _mean_silhouette(rows: DataFrame) -> DataFrame:
    """Rows with mean distances ``a`` (missing for singletons) and ``b`` to one mean."""
    a, b = F.col("a"), F.col("b")
    s = F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    return rows.agg(F.when(F.count(b) > 0, F.avg(s)).alias("silhouette_score"))


def silhouette(
    df: DataFrame, cluster_col: str, cols: Sequence[str], id_col: str, *, tile_rows: int = 2048
) -> DataFrame:
    """Mean silhouette under Euclidean distance, exact, noise counted as a cluster.

    Rows are hashed into groups of about ``tile_rows``, in large tables of up to ``MOST_ROWS``; one
    task handles one pair of groups, in blocks, and emits a distance sum per (row, cluster), never
    a pair of rows.  The work is quadratic by definition: use ``silhouette_sq`` on very large tables.
    """
    n = df.count()
    groups = max(1, min(-(-n // tile_rows), max(GROUPS, -(-n // MOST_ROWS))))
    rows = df.select(F.col(id_col).alias("id"), F.col(cluster_col).cast("long").alias("c"), _vector(cols).alias("x"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    tiles = rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tiles = tiles.withColumns({"i": F.least("g", "h"), "j": F.greatest("g", "h")})
    sums = tiles.groupBy("i", "j").applyInPandas(_tile_sums, "id long, c long, other long, d double")
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"))
    size = sizes.agg(F.map_from_entries(F.collect_list(F.struct("c", "n")))).scalar()
    mean = sums.groupBy("id", "c", "other").agg(F.sum("d").alias("d")).withColumn("n", F.element_at(size, F.col("other")))
    own = F.col("c") == F.col("other")
    return _mean_silhouette(
        mean.groupBy("id").agg(
            F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("a"),
            F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"),
        )
    )


def _tile_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    return tile_distance_sums(pdf)


def davies_bouldin(df: DataFrame, cluster_col: str, cols: Sequence[str]) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / centre distance."""
    rows = df.select(F.col(cluster_col).alias("c"), _vector(cols).alias("x"))
    means = [F.avg(F.get("x", F.lit(i))) for i in range(len(cols))]
    centres = rows.groupBy("c").agg(F.array(*means).alias("m"))
    centre = centres.agg(F.map_from_entries(F.collect_list(F.struct("c", "m")))).scalar()
    rows = rows.withColumn("m", F.element_at(centre, F.col("c")))
    per = rows.groupBy("c").agg(F.avg(F.sqrt(_sq_distance(F.col("x"), F.col("m")))).alias("s"), F.first("m").alias("m"))
    per = per.withColumn("every", F.collect_list(F.struct("c", "s", "m")).over(Window.partitionBy()))
    ratios = F.transform(
        F.filter("every", lambda g: g["c"] != F.col("c")),
        lambda g: F.try_divide(F.col("s") + g["s"], F.sqrt(_sq_distance(F.col("m"), g["m"]))),
    )
    return per.select(F.array_max(ratios).alias("worst")).agg(F.avg("worst").alias("davies_bouldin_index"))


def cluster_metrics(
    df: DataFrame, cluster_col: str, cols: Sequence[str], id_col: str, *, squared: bool = True
) -> DataFrame:
    """Silhouette, Davies-Bouldin, cluster count and noise share on scaled columns.

    The two quality measures are missing below two non-noise clusters.  The silhouette is the
    linear one under squared distances; ``squared=False`` asks for the exact one under plain
    distances, whose work is quadratic.
    """
    scaled = cut_lineage(standardize(df.select(id_col, cluster_col, *cols), cols))  # read for each measure
    shape = silhouette_sq(scaled, cluster_col, cols) if squared else silhouette(scaled, cluster_col, cols, id_col)
    enough = F.col("n_clusters") >= 2
    return cluster_counts(df, cluster_col).withColumns(
        {
            "silhouette_score": F.when(enough, shape.scalar()),
            "davies_bouldin_index": F.when(enough, davies_bouldin(scaled, cluster_col, cols).scalar()),
        }
    )
