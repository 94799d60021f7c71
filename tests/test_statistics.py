import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import distributions as dist
from gaugeflow.operators import describe, diagnostics, hypothesis


def frame(spark, **cols):
    names = list(cols)
    rows = [tuple(float(x) if isinstance(x, (float, np.floating)) else x for x in r) for r in zip(*cols.values())]
    return spark.createDataFrame(rows, names)


def test_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 10), 30]], "x double")
    r = describe.describe_columns(df).first()
    assert r["skewness"] == pytest.approx(2.607630, abs=1e-6)
    assert r["excess_kurtosis"] == pytest.approx(7.503963, abs=1e-6)
    assert r["variance"] == pytest.approx(69.166667, abs=1e-6)
    assert (r["median"], r["n"], r["min"], r["max"]) == (5.5, 10, 1, 30)


def test_moments_of_few_rows(spark):
    r = describe.describe_columns(spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")).first()
    assert (r["n"], r["median"], r["skewness"], r["excess_kurtosis"]) == (2, 1.5, None, None)


def test_correlation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=50), rng.normal(size=50)
    df = frame(spark, a=a, b=b).withColumn("k", F.lit(1.0))
    m = {(r["a"], r["b"]): r["r"] for r in describe.correlation_matrix(df).collect()}
    assert m[("a", "a")] == pytest.approx(1) and m[("a", "b")] == m[("b", "a")] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert m[("a", "k")] is None
    assert describe.correlation_lower_triangle(df).count() == 6


def test_wide_correlation(spark):
    rng = np.random.default_rng(6)
    cols = {f"c{i}": rng.normal(size=60) + 1000 for i in range(9)}
    df = frame(spark, **cols).withColumn("k", F.lit(3.0))
    want = np.corrcoef(np.array(list(cols.values())))
    for holed in (False, True):
        given = df.withColumn("c0", F.when(F.col("c1") > 0, F.col("c0"))) if holed else df
        if holed:
            given = given.unionByName(given.limit(1).withColumn("c0", F.lit(None).cast("double")))
        m = {(r["i"], r["j"]): r["r"] for r in describe.correlation_matrix(given).collect()}
        assert len(m) == 100 and m[(9, 9)] is None and m[(2, 9)] is None
        assert m[(0, 3)] == pytest.approx(want[0, 3]) and m[(4, 4)] == pytest.approx(1)


def test_crosstab_has_observed_rows_only(spark):
    df = spark.createDataFrame([("Low", 0), ("Low", 0), ("High", 1), (None, 1)], "b string, f int")
    got = {(r["row"], r["column"]): r["n"] for r in describe.crosstab(df, "b", "f").collect()}
    assert got == {("Low", 0): 2, ("Low", 1): 0, ("High", 0): 0, ("High", 1): 1}


def test_tails(spark):
    assert dist.student_two_sided(2.0, 10.5) == pytest.approx(0.0720338, abs=1e-7)
    assert dist.f_upper(17.599226, 3, 9347) == pytest.approx(2.17496e-11, rel=1e-4)
    assert dist.chi2_upper(3.448018, 2) == pytest.approx(math.exp(-3.448018 / 2))
    assert dist.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    q = spark.createDataFrame([(0.5,), (0.975,), (1e-12,), (0.0,)], "p double").select(dist.normal_quantile("p").alias("z"))
    z = [r["z"] for r in q.collect()]
    assert z[0] == 0 and z[1] == pytest.approx(1.959963984540054) and z[2] == pytest.approx(-7.034483825, abs=1e-8) and z[3] is None


def test_chi_square_golden(spark):
    cells = [("Low", 0, 17), ("Medium", 0, 4946), ("Medium", 1, 956), ("High", 0, 2888), ("High", 1, 544)]
    df = spark.createDataFrame(cells, "b string, f int, n int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = hypothesis.chi_square_independence(df, "b", "f").first()
    assert r["chi2_statistic"] == pytest.approx(3.448018, abs=1e-6)
    assert r["degrees_of_freedom"] == 2 and r["p_value"] == pytest.approx(0.178350, abs=1e-6)
    assert not r["significant_at_0_05"]


def test_chi_square_yates(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("b", 0, 20), ("b", 1, 10)], "b string, f int, n int")
    df = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = hypothesis.chi_square_independence(df, "b", "f").first()
    assert r["chi2_statistic"] == pytest.approx(4 * 4.5**2 / 15) and r["degrees_of_freedom"] == 1


def test_welch(spark):
    rng = np.random.default_rng(3)
    g, v = rng.normal(size=101), rng.normal(size=101)
    df = frame(spark, g=g, v=v)
    hi, lo = v[g >= np.median(g)], v[g < np.median(g)]
    se = hi.var(ddof=1) / len(hi) + lo.var(ddof=1) / len(lo)
    r = hypothesis.welch_ttest(df, "v", "g").first()
    assert r["t_statistic"] == pytest.approx((hi.mean() - lo.mean()) / math.sqrt(se))
    assert (r["group_high_n"], r["group_low_n"]) == (51, 50)
    assert r["p_value"] == pytest.approx(dist.student_two_sided(r["t_statistic"], r["degrees_of_freedom"]))


def test_halves_of_text_numbers(spark):
    df = spark.createDataFrame([("1,5",), ("2",), ("10",), ("x",)], "t string")
    assert [r["half"] for r in hypothesis.split_high_low(df, "t").collect()] == ["low", "high", "high", None]


def test_anova(spark):
    df = spark.createDataFrame([(g, x) for g, xs in (("a", (1.0, 2, 3)), ("b", (2.0, 4, 6)), ("c", (5.0, 5, 8))) for x in map(float, xs)] + [("a", None)], "g string, v double")
    r = hypothesis.anova_oneway(df, "v", "g").first()
    means, n = [2, 4, 6], 3
    between, within = sum(n * (m - 4) ** 2 for m in means) / 2, (2 + 8 + 6) / 6
    assert r["f_statistic"] == pytest.approx(between / within)
    assert (r["df_between"], r["df_within"]) == (2, 6)


def test_degenerate_groups_give_missing_not_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    r = hypothesis.anova_oneway(df, "v", "g").first()
    assert (r["f_statistic"], r["p_value"]) == (None, None)
    r = hypothesis.welch_ttest(df.limit(1), "v", "v").first()
    assert (r["t_statistic"], r["p_value"], r["group_high_n"]) == (None, None, 1)
    r = hypothesis.chi_square_independence(df.limit(1), "g", "v").first()
    assert (r["chi2_statistic"], r["degrees_of_freedom"], r["p_value"]) == (0, 0, 1)
    assert describe.cluster_profile(df, "g", ["v"]).first()["v"] is None
    constant = spark.createDataFrame([(i, 1.0) for i in range(9)], "i int, e double")
    r = diagnostics.residual_diagnostics(constant, "e", ["i"]).first()
    assert r["durbin_watson"] == 0 and r["jarque_bera_statistic"] is None


def test_vif(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=200), rng.normal(size=200)
    c = a + 0.5 * b + 0.3 * rng.normal(size=200)
    df = frame(spark, a=a, b=b, c=c).withColumn("k", F.lit(2.0)).withColumn("twin", F.col("a") * 2)
    got = {r["feature"]: r["vif"] for r in diagnostics.vif(df, ["a", "b", "c"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(np.array([a, b, c]))))
    assert [got[x] for x in "abc"] == pytest.approx(list(want))
    got = {r["feature"]: r["vif"] for r in diagnostics.vif(df, ["a", "b", "twin", "k"]).collect()}
    assert got["a"] == got["twin"] == got["k"] == math.inf and 1 <= got["b"] < 2


def test_residual_checks(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(e)], "i long, e double")
    r = diagnostics.residual_diagnostics(df, "e", ["i"]).first()
    s, k = ((e - e.mean()) ** 3).mean() / e.std() ** 3, ((e - e.mean()) ** 4).mean() / e.std() ** 4 - 3
    jb = 400 / 6 * (s * s + k * k / 4)
    assert r["jarque_bera_statistic"] == pytest.approx(jb) and r["jarque_bera_p"] == pytest.approx(math.exp(-jb / 2))
    assert r["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    assert r["mean_residual"] == pytest.approx(e.mean()) and r["std_residual"] == pytest.approx(e.std())
    assert r["normality"] == "Residuals are approximately normal" and r["autocorrelation"] == "No significant autocorrelation"
    skewed = df.withColumn("e", F.exp("e"))
    assert diagnostics.residual_diagnostics(skewed, "e", ["i"]).first()["normality"] == "Residuals deviate from normality"


def test_qq_points_in_blocks(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.random.default_rng(9).normal(size=200))], "i long, x double")
    plain = {r["i"]: (r["rank"], r["theoretical"]) for r in diagnostics.qq_points(df, "x", ["i"]).collect()}
    blocked = {r["i"]: (r["rank"], r["theoretical"]) for r in diagnostics.qq_points(df, "x", ["i"], block_rows=20).collect()}
    assert plain == blocked
    line = diagnostics.qq_line(diagnostics.qq_points(df, "x", ["i"])).first()
    assert line["slope"] == pytest.approx(1, abs=0.15) and line["r"] > 0.98
