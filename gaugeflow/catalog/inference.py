"""Hypothesis tests and residual diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.aggregates import CROSSTAB_SQL, bucketed
from gaugeflow.catalog.columns import normal_quantile_sql
from gaugeflow.catalog.ordered_rows import FILLIBEN, ORDER, SERIES
from gaugeflow.catalog.registry import query, rounded
from gaugeflow.functions import scalar
from gaugeflow.operators import diagnostics, hypothesis


@query(
    "split_high_low",
    "SELECT o_orderkey, CASE WHEN o_totalprice >= (SELECT median(o_totalprice) FROM orders) THEN 'high' ELSE 'low' END AS half FROM orders",
)
def _(t):
    df = t("orders").select("o_orderkey", "o_totalprice")
    return hypothesis.split_high_low(df, "o_totalprice").select("o_orderkey", "half")


@query(
    "welch_ttest",
    "WITH h AS (SELECT l_extendedprice AS x, l_quantity >= (SELECT median(l_quantity) FROM lineitem) AS hi FROM lineitem), "
    "s AS (SELECT count(*) FILTER (hi) AS nh, avg(x) FILTER (hi) AS mh, var_samp(x) FILTER (hi) / count(*) FILTER (hi) AS eh, "
    "count(*) FILTER (NOT hi) AS nl, avg(x) FILTER (NOT hi) AS ml, var_samp(x) FILTER (NOT hi) / count(*) FILTER (NOT hi) AS el FROM h) "
    "SELECT round((mh - ml) / sqrt(eh + el), 4) AS t_statistic, round((eh + el) ** 2 / (eh * eh / (nh - 1) + el * el / (nl - 1)), 2) AS degrees_of_freedom, "
    "round(mh, 4) AS group_high_mean, round(ml, 4) AS group_low_mean, nh AS group_high_n, nl AS group_low_n FROM s",
)
def _(t):
    out = hypothesis.welch_ttest(t("lineitem"), "l_extendedprice", "l_quantity")
    out = rounded(out, "t_statistic", "group_high_mean", "group_low_mean", digits=4)
    return rounded(out.drop("p_value", "significant_at_0_05"), "degrees_of_freedom", digits=2)


@query(
    "welch_p_value",
    # The density of Student's t, integrated from 0 to |t| by Simpson's rule.
    "WITH h AS (SELECT value AS x, user_id >= (SELECT median(user_id) FROM events) AS hi FROM events), "
    "s AS (SELECT count(*) FILTER (hi) AS nh, avg(x) FILTER (hi) AS mh, var_samp(x) FILTER (hi) / count(*) FILTER (hi) AS eh, "
    "count(*) FILTER (NOT hi) AS nl, avg(x) FILTER (NOT hi) AS ml, var_samp(x) FILTER (NOT hi) / count(*) FILTER (NOT hi) AS el FROM h), "
    "w AS (SELECT (mh - ml) / sqrt(eh + el) AS t, (eh + el) ** 2 / (eh * eh / (nh - 1) + el * el / (nl - 1)) AS dof FROM s), "
    "g AS (SELECT t, abs(t) / 2000 AS step, dof, exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) AS c FROM w), "
    "f AS (SELECT t, step * c * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
    "* (1 + (i * step) ** 2 / dof) ** (-(dof + 1) / 2)) / 3 AS half FROM g, range(2001) AS r(i) GROUP BY t, step, c) "
    "SELECT round(t, 6) AS t_statistic, round(1 - 2 * half, 6) AS p_value, 1 - 2 * half < 0.05 AS significant_at_0_05 FROM f",
)
def _(t):
    out = hypothesis.welch_ttest(t("events"), "value", "user_id")
    return rounded(out.select("t_statistic", "p_value", "significant_at_0_05"), "t_statistic", "p_value")


@query(
    "anova_oneway",
    "WITH s AS (SELECT (month(o_orderdate) % 12) // 3 AS g, o_totalprice AS x FROM orders), "
    "k AS (SELECT g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM s GROUP BY g), "
    "f AS (SELECT count(*) - 1 AS d1, CAST(sum(n) AS BIGINT) - count(*) AS d2, sum(n * (m - (SELECT avg(x) FROM s)) ** 2) AS b, sum(n * v) AS w FROM k) "
    "SELECT round((b / d1) / (w / d2), 5) AS f_statistic, d1 AS df_between, d2 AS df_within FROM f",
)
def _(t):
    df = t("orders").withColumn("season", scalar.season_of("o_orderdate"))
    out = hypothesis.anova_oneway(df, "o_totalprice", "season")
    return rounded(out.select("f_statistic", "df_between", "df_within"), "f_statistic", digits=5)


# With three groups the F tail has a closed form: (1 + 2 F / d2) ** (-d2 / 2).
@query(
    "anova_p_value",
    "WITH k AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_tax) AS m, var_pop(l_tax) AS v FROM lineitem GROUP BY 1), "
    "f AS (SELECT CAST(sum(n) AS BIGINT) - 3 AS d2, (sum(n * (m - (SELECT avg(l_tax) FROM lineitem)) ** 2) / 2) / (sum(n * v) / (sum(n) - 3)) AS f FROM k) "
    "SELECT round(f, 5) AS f_statistic, round(pow(1 + 2 * f / d2, -d2 / 2), 5) AS p_value, pow(1 + 2 * f / d2, -d2 / 2) < 0.05 AS significant_at_0_05 FROM f",
)
def _(t):
    out = hypothesis.anova_oneway(t("lineitem"), "l_tax", "l_returnflag").drop("df_between", "df_within")
    return rounded(out, "f_statistic", "p_value", digits=5)


@query(
    "chi_square_independence",
    f"WITH {CROSSTAB_SQL}, e AS (SELECT n, sum(n) OVER (PARTITION BY \"row\") * sum(n) OVER (PARTITION BY \"column\") / (sum(n) OVER ())::DOUBLE AS x FROM cells), "
    "d AS (SELECT (SELECT (count(DISTINCT \"row\") - 1) * (count(DISTINCT \"column\") - 1) FROM cells) AS dof), "
    "c AS (SELECT sum((n - x) ** 2 / x) AS chi2 FROM e) "
    "SELECT round(chi2, 4) AS chi2_statistic, dof AS degrees_of_freedom, round(exp(-chi2 / 2), 6) AS p_value, exp(-chi2 / 2) < 0.05 AS significant_at_0_05 FROM c, d",
)
def _(t):
    out = hypothesis.chi_square_independence(bucketed(t), "bucket", "flag")
    return rounded(rounded(out, "chi2_statistic", digits=4), "p_value")


@query(
    "vif",
    "SELECT c AS feature, round(v, 6) AS vif FROM (SELECT 1 / (1 - corr(l_quantity, l_extendedprice) ** 2) AS v FROM lineitem), "
    "(VALUES ('l_quantity'), ('l_extendedprice')) n(c)",
)
def _(t):
    return rounded(diagnostics.vif(t("lineitem"), ["l_quantity", "l_extendedprice"]), "vif")


# R^2 on two other features a and b: (ra^2 + rb^2 - 2 ra rb rab) / (1 - rab^2).
VIF_SQL = " UNION ALL ".join(
    f"SELECT '{x}' AS feature, round(1 / (1 - (ra * ra + rb * rb - 2 * ra * rb * rab) / (1 - rab * rab)), 6) AS vif FROM "
    f"(SELECT corr({x}, {a}) AS ra, corr({x}, {b}) AS rb, corr({a}, {b}) AS rab FROM v)"
    for x, a, b in (("q", "p", "w"), ("p", "q", "w"), ("w", "q", "p"))
)


@query("vif_many", f"WITH v AS (SELECT l_quantity AS q, l_extendedprice AS p, l_quantity * l_discount AS w FROM lineitem) {VIF_SQL}")
def _(t):
    df = t("lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), (F.col("l_quantity") * F.col("l_discount")).alias("w")
    )
    return rounded(diagnostics.vif(df, ["q", "p", "w"]), "vif")


# Population moments for DuckDB, whose skewness and kurtosis are bias-corrected.
POP = (
    "SELECT count(*) AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS s, avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS k "
    "FROM (SELECT l_discount - (SELECT avg(l_discount) FROM lineitem) AS d FROM lineitem)"
)


@query("jarque_bera", f"SELECT round(jb, 3) AS statistic, round(exp(-jb / 2), 6) AS p_value FROM (SELECT n / 6.0::DOUBLE * (s * s + k * k / 4) AS jb FROM ({POP}))")
def _(t):
    return rounded(rounded(diagnostics.jarque_bera(t("lineitem"), "l_discount"), "statistic", digits=3), "p_value")


@query(
    "durbin_watson",
    "SELECT event_type, round(sum((e - prev) ** 2) / sum(e * e), 6) AS durbin_watson FROM ("
    "SELECT event_type, value - 50 AS e, lag(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events) GROUP BY event_type",
)
def _(t):
    df = t("events").withColumn("e", F.col("value") - 50)
    return rounded(diagnostics.durbin_watson(df, "e", ORDER, SERIES), "durbin_watson")


@query(
    "residual_summary",
    "SELECT round(avg(e), 6) + 0.0 AS mean_residual, round(stddev_pop(e), 6) AS std_residual, "
    "CASE WHEN sum((e - prev) ** 2) / sum(e * e) > 1.5 AND sum((e - prev) ** 2) / sum(e * e) < 2.5 THEN 'No significant autocorrelation' "
    "ELSE 'Possible autocorrelation detected (expected for time-series)' END AS autocorrelation "
    "FROM (SELECT value - 50 AS e, lag(value - 50) OVER (ORDER BY ts, event_id) AS prev FROM events)",
)
def _(t):
    df = t("events").withColumn("e", F.col("value") - 50)
    dw = diagnostics.durbin_watson(df, "e", ORDER).scalar()
    out = diagnostics.residual_summary(df, "e").withColumn("autocorrelation", diagnostics.verdict_autocorrelation(dw))
    return rounded(out, "mean_residual", "std_residual")


@query(
    "residual_diagnostics",
    "WITH e AS (SELECT value - 50 AS e, lag(value - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events), "
    "m AS (SELECT avg(e) AS m, stddev_pop(e) AS s, sum((e - prev) ** 2) / sum(e * e) AS dw FROM e), "
    "p AS (SELECT count(*) AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS s, avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS k "
    "FROM (SELECT e - (SELECT m FROM m) AS d FROM e)), "
    "j AS (SELECT n / 6.0::DOUBLE * (s * s + k * k / 4) AS jb FROM p), "
    f"w AS (SELECT corr(value, z) ** 2 AS w FROM (SELECT value, {normal_quantile_sql('p')} AS z FROM ({FILLIBEN}))) "
    "SELECT round(m, 6) + 0.0 AS mean_residual, round(s, 6) AS std_residual, round(w, 6) AS normality_statistic, "
    "round(exp(-jb / 2), 6) + 0.0 AS normality_p, round(jb, 3) AS jarque_bera_statistic, round(exp(-jb / 2), 6) + 0.0 AS jarque_bera_p, "
    "round(dw, 6) AS durbin_watson, CASE WHEN exp(-jb / 2) > 0.05 THEN 'Residuals are approximately normal' "
    "ELSE 'Residuals deviate from normality' END AS normality, CASE WHEN dw > 1.5 AND dw < 2.5 THEN 'No significant autocorrelation' "
    "ELSE 'Possible autocorrelation detected (expected for time-series)' END AS autocorrelation FROM m, j, w",
)
def _(t):
    out = diagnostics.residual_diagnostics(t("events").withColumn("e", F.col("value") - 50), "e", ORDER, SERIES)
    out = rounded(out, "mean_residual", "std_residual", "normality_statistic", "normality_p", "jarque_bera_p", "durbin_watson")
    return rounded(out, "jarque_bera_statistic", digits=3)


@query(
    "normality_at_scale",
    f"SELECT round(corr(value, z) ** 2, 6) AS statistic, count(*) AS n FROM (SELECT value, {normal_quantile_sql('p')} AS z FROM ({FILLIBEN}))",
)
def _(t):
    return rounded(diagnostics.normality_at_scale(t("events"), "value", ["event_id"]), "statistic")


@query(
    "qq_line",
    f"SELECT round(regr_slope(value, z), 6) AS slope, round(regr_intercept(value, z), 6) AS intercept, round(corr(value, z), 6) AS r "
    f"FROM (SELECT value, {normal_quantile_sql('p')} AS z FROM ({FILLIBEN}))",
)
def _(t):
    return rounded(diagnostics.qq_line(diagnostics.qq_points(t("events"), "value", ["event_id"])), "slope", "intercept", "r")


# A fixed linear predictor of a label that it explains in part; rows are ordered by a hash that both engines have.
_PREDICTED = "500 * month + 30 * cust"
_SHUFFLED = ["month", "cust", "weekday"]


@query(
    "permutation_importance",
    f"""WITH b AS (SELECT o_orderkey, month(o_orderdate)::BIGINT AS month, o_custkey % 100 AS cust, isodow(o_orderdate)::BIGINT AS weekday,
  o_totalprice * 0.01 + 500 * month(o_orderdate) + 30 * (o_custkey % 100) AS y FROM orders),
h AS (SELECT *, ('0x' || substr(md5(concat_ws('-', o_orderkey, r + 42)), 1, 15))::BIGINT AS h FROM b, range(10) g(r)),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY h DESC, o_orderkey DESC) AS back,
  {", ".join(f"lag({c}) OVER w AS o_{c}" for c in _SHUFFLED)} FROM h WINDOW w AS (PARTITION BY r ORDER BY h, o_orderkey)),
z AS (SELECT r, {", ".join(f"{c} AS z_{c}" for c in _SHUFFLED)} FROM o WHERE back = 1),
s AS (SELECT o.*, f.feature, z.* EXCLUDE (r) FROM o JOIN z USING (r), (VALUES {", ".join(f"('{c}')" for c in _SHUFFLED)}) AS f(feature)),
p AS (SELECT r, feature, y, {_PREDICTED} AS p FROM (SELECT r, feature, y,
  {", ".join(f"CASE WHEN feature = '{c}' THEN coalesce(o_{c}, z_{c}) ELSE {c} END AS {c}" for c in _SHUFFLED)} FROM s)),
m AS (SELECT feature, avg(score) AS shuffled FROM (SELECT r, feature, 1 - avg((y - p) ** 2) / var_pop(y) AS score FROM p GROUP BY r, feature)
  GROUP BY feature)
SELECT feature, round((SELECT 1 - avg((y - ({_PREDICTED})) ** 2) / var_pop(y) FROM b) - shuffled, 6) + 0.0 AS importance FROM m""",
)
def _(t):
    month, cust = scalar.month_of("o_orderdate"), F.col("o_custkey") % 100
    df = t("orders").select(
        "o_orderkey", month.alias("month"), cust.alias("cust"), (F.weekday("o_orderdate") + 1).alias("weekday"),
        (F.col("o_totalprice") * 0.01 + 500 * month + 30 * cust).alias("y"),
    )
    predict = lambda x: x.withColumn("prediction", F.expr(_PREDICTED))
    return rounded(diagnostics.permutation_importance(df, predict, _SHUFFLED, "y", ["o_orderkey"], repeats=10), "importance")
