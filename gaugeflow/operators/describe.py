"""Column statistics, correlations, group means and contingency counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.scalar import correlation
from gaugeflow.operators.cleaning import numeric_columns
from gaugeflow.plans.ordered import exact_medians, known


def describe_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column over its known values (NaN is missing), with bias-corrected moments.

    Everything but the median is one map-side combined aggregate.  Medians come from
    histogram passes, which keep no values in memory.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    medians = exact_medians(df, cols) if cols else {}
    raw = []
    for c in cols:
        x = known(F.col(c))
        raw += [
            F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"mean_{c}"), F.var_samp(x).alias(f"var_{c}"),
            F.skewness(x).alias(f"g1_{c}"), F.kurtosis(x).alias(f"g2_{c}"),
            F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"),
        ]
    one = df.agg(*raw)
    structs = []
    for c in cols:
        n, g1, g2 = F.col(f"n_{c}"), F.col(f"g1_{c}"), F.col(f"g2_{c}")
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2))
        kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6))
        structs.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"mean_{c}").alias("mean"), F.col(f"var_{c}").alias("variance"),
                F.sqrt(F.col(f"var_{c}")).alias("std"), _known(skew).alias("skewness"),
                _known(kurt).alias("excess_kurtosis"), F.col(f"min_{c}").alias("min"),
                F.col(f"max_{c}").alias("max"),
                F.lit(medians[c]).cast("double").alias("median"), n.alias("n"),
            )
        )
    return one.select(F.inline(F.array(*structs)))


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long ``(a, b, i, j, r)`` Pearson matrix over pairwise complete rows.

    All pairs are aggregated in one map-side combined pass.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    one = df.agg(*[correlation(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    cells = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            r = _known(F.col(f"r_{max(i, j)}_{min(i, j)}"))
            cells.append(
                F.struct(
                    F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"),
                    F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r"),
                )
            )
    return one.select(F.inline(F.array(*cells)))


def correlation_lower_triangle(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Heatmap cells: the lower triangle with its diagonal."""
    return correlation_matrix(df, cols).filter(F.col("i") >= F.col("j"))


def group_mean(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    return df.groupBy(group_col).agg(F.avg(value_col).alias("mean"))


def crosstab(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Long ``(row, column, n)`` counts; zero cells appear for observed rows x columns only."""
    known = df.filter(F.col(row_col).isNotNull() & F.col(col_col).isNotNull())
    counts = known.groupBy(F.col(row_col).alias("row"), F.col(col_col).alias("column")).agg(F.count("*").alias("n"))
    every = counts.agg(F.sort_array(F.collect_set("column"))).scalar()
    rows = counts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("cells"))
    rows = rows.withColumn("column", F.explode(every))
    n = F.coalesce(F.try_element_at("cells", F.col("column")), F.lit(0).cast("long"))
    return rows.select("row", "column", n.alias("n"))


def class_balance(df: DataFrame, label_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg(label_col).alias("positive_share"))


def cluster_profile(df: DataFrame, cluster_col: str, cols: Sequence[str]) -> DataFrame:
    """Column means per cluster as z-scores across clusters (sample deviation)."""
    means = df.groupBy(cluster_col).agg(*[F.avg(c).alias(c) for c in cols])
    parts = [f(c).alias(f"{t}_{c}") for c in cols for t, f in (("m", F.avg), ("s", F.stddev_samp))]
    across = means.agg(F.struct(*parts)).scalar()
    return means.select(
        cluster_col,
        *[F.try_divide(F.col(c) - across[f"m_{c}"], across[f"s_{c}"]).alias(c) for c in cols],
    )


def cluster_counts(df: DataFrame, cluster_col: str) -> DataFrame:
    """Number of clusters without noise (-1), and the share of noise rows."""
    sizes = df.groupBy(cluster_col).agg(F.count("*").alias("n"))
    noise = F.col(cluster_col) == -1
    return sizes.agg(
        F.count(F.when(~noise, 1)).alias("n_clusters"),
        (F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_ratio"),
    )
