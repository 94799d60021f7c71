"""Welch t-test, one-way ANOVA and chi-square independence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions import scalar
from gaugeflow.functions.distributions import chi2_p, f_p, student_p
from gaugeflow.operators.describe import crosstab
from gaugeflow.plans import defaults
from gaugeflow.plans.ordered import exact_medians, known


def exact_median(df: DataFrame, col: str) -> Column:
    """The median of the known values as a column, from histogram passes."""
    return F.lit(exact_medians(df, [col])[col]).cast("double")


def split_high_low(df: DataFrame, group_col: str, name: str = "half") -> DataFrame:
    """``high`` at or above the median of ``group_col``, ``low`` below, missing if unknown.

    Text in ``group_col`` is read as numbers.
    """
    text = isinstance(df.schema[group_col].dataType, T.StringType)
    g = scalar.coerce_number(group_col) if text else F.col(group_col)
    g = known(g)
    median = exact_median(df.select(g.alias("g")), "g")
    return df.withColumn(name, F.when(g >= median, F.lit("high")).when(g < median, F.lit("low")))


def welch_ttest(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """Unequal-variance t-test of the value between the halves above and below the median."""
    halves = split_high_low(df, group_col).filter(
        F.col("half").isNotNull() & F.col(value_col).isNotNull()
    )
    v = F.col(value_col).cast("double")
    parts = []
    for side in ("high", "low"):
        x = F.when(F.col("half") == side, v)
        parts += [F.count(x).alias(f"n_{side}"), F.avg(x).alias(f"m_{side}"), F.var_samp(x).alias(f"v_{side}")]
    one = halves.agg(*parts)
    se_h, se_l = F.try_divide("v_high", "n_high"), F.try_divide("v_low", "n_low")
    t = F.try_divide(F.col("m_high") - F.col("m_low"), F.sqrt(se_h + se_l))
    dof = F.try_divide(
        (se_h + se_l) * (se_h + se_l),
        F.try_divide(se_h * se_h, F.col("n_high") - 1) + F.try_divide(se_l * se_l, F.col("n_low") - 1),
    )
    out = one.select(
        t.alias("t_statistic"), dof.alias("degrees_of_freedom"),
        F.col("m_high").alias("group_high_mean"), F.col("m_low").alias("group_low_mean"),
        F.col("n_high").alias("group_high_n"), F.col("n_low").alias("group_low_n"),
    )
    return _with_p(out, student_p("t_statistic", "degrees_of_freedom"))


def _with_p(df: DataFrame, p: Column) -> DataFrame:
    return df.withColumn("p_value", p).withColumn("significant_at_0_05", F.col("p_value") < 0.05)


def anova_oneway(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """F test of equal group means, from per-group counts, means and variances."""
    v = F.col(value_col).cast("double")
    groups = (
        df.filter(F.col(group_col).isNotNull() & v.isNotNull())
        .groupBy(group_col)
        .agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    )
    n, m = F.col("n"), F.col("m")
    grand = groups.agg(F.sum(n * m) / F.sum(n)).scalar()
    one = groups.withColumn("dev", m - grand).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        F.sum(n * F.col("dev") * F.col("dev")).alias("between"),
        F.sum(n * F.col("s2")).alias("within"),
    )
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    out = one.select(
        F.try_divide(F.try_divide("between", d1), F.try_divide("within", d2)).alias("f_statistic"),
        d1.alias("df_between"),
        d2.alias("df_within"),
    )
    return _with_p(out, f_p("f_statistic", F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def chi_square_independence(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Pearson chi-square of a contingency table, Yates-corrected for one degree of freedom."""
    cells = crosstab(df, row_col, col_col)
    n = F.col("n")
    total = cells.agg(F.sum(n)).scalar()
    rows = cells.groupBy("row").agg(F.sum(n).alias("rt"))
    cols = cells.groupBy("column").agg(F.sum(n).alias("ct"))
    cells = cells.join(rows, "row").join(cols, "column")
    cells = cells.withColumn("expected", F.col("rt") * F.col("ct") / total)
    miss = F.abs(n - F.col("expected"))
    one = cells.agg(
        F.sum(miss * miss / F.col("expected")).alias("plain"),
        F.sum(F.pow(miss - F.least(F.lit(0.5), miss), F.lit(2.0)) / F.col("expected")).alias("yates"),
        ((F.count_distinct("row") - 1) * (F.count_distinct("column") - 1)).alias("degrees_of_freedom"),
    )
    out = one.select(
        F.when(F.col("degrees_of_freedom") == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2_statistic"),
        "degrees_of_freedom",
    )
    return _with_p(out, chi2_p("chi2_statistic", F.col("degrees_of_freedom").cast("double")))


def humidity_independence(
    df: DataFrame,
    flag_col: str = defaults.FLAG,
    value_col: str = "Rel_Humidity",
    edges: Sequence[float] = defaults.HUMIDITY_EDGES,
    labels: Sequence[str] = defaults.HUMIDITY_LABELS,
) -> DataFrame:
    """Chi-square of a 0/1 flag against a bucketed measurement."""
    bucketed = df.withColumn("__bucket", scalar.bucketize(value_col, edges, labels))
    return chi_square_independence(bucketed, "__bucket", flag_col)
