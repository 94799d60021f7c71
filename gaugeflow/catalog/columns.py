"""Projections, filters and row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.registry import SERIES_SQL, query, r, rounded
from gaugeflow.functions import distributions, scalar
from gaugeflow.operators import cleaning, features, scaling
from gaugeflow.plans import defaults
from gaugeflow.sources import payloads

DATED = (
    "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'no date' ELSE strftime(ts, '%d/%m/%Y') END AS d, "
    "strftime(ts, '%H.%M.%S') AS t FROM events"
)


def _dated(t):
    day = F.when(F.col("event_id") % 50 == 0, F.lit("no date")).otherwise(F.date_format("ts", "dd/MM/yyyy"))
    return t("events").select("event_id", day.alias("Date"), F.date_format("ts", "HH.mm.ss").alias("Time"))


@query("parse_datetime", f"SELECT event_id, try_strptime(d || ' ' || t, '%d/%m/%Y %H.%M.%S') AS \"DateTime\" FROM ({DATED})")
def _(t):
    return cleaning.parse_datetime(_dated(t))


@query("drop_missing_key", f"SELECT event_id, try_strptime(d || ' ' || t, '%d/%m/%Y %H.%M.%S') AS \"DateTime\" FROM ({DATED}) WHERE d <> 'no date'")
def _(t):
    return cleaning.drop_missing_key(cleaning.parse_datetime(_dated(t)))


@query("sentinel_to_null", f"WITH {SERIES_SQL} SELECT event_id, nullif(v, -200) AS v FROM s")
def _(t):
    return cleaning.sentinel_to_null(t.series(), cols=["v"]).select("event_id", "v")


SPARSE = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS half, CASE WHEN event_id % 3 = 0 THEN value END AS third FROM events"


def _sparse(t):
    eid, v = F.col("event_id"), F.col("value")
    return t("events").select("event_id", F.when(eid % 2 != 0, v).alias("half"), F.when(eid % 3 == 0, v).alias("third"))


@query("drop_sparse_columns", f"SELECT event_id, half FROM ({SPARSE})")
def _(t):
    return cleaning.drop_sparse_columns(_sparse(t))


@query("missing_fraction", f"SELECT 'half' AS \"column\", round(avg(CAST(half IS NULL AS INT)), 6) AS fraction FROM ({SPARSE}) UNION ALL SELECT 'third', round(avg(CAST(third IS NULL AS INT)), 6) FROM ({SPARSE})")
def _(t):
    return rounded(cleaning.missing_fraction(_sparse(t), ["half", "third"]), "fraction")


@query("drop_any_null", f"SELECT * FROM ({SPARSE}) WHERE half IS NOT NULL AND third IS NOT NULL")
def _(t):
    return cleaning.drop_any_null(_sparse(t))


@query("feature_columns", "SELECT l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem")
def _(t):
    df = t("lineitem").drop("l_linenumber", "l_tax")
    return df.select(*features.feature_columns(df, ["l_orderkey", "l_extendedprice"]))


@query("assemble", "SELECT l_orderkey, l_linenumber, l_extendedprice AS label, round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem")
def _(t):
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")
    df = features.assemble(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return df.select("l_orderkey", "l_linenumber", "label", r(x[0] + x[1] + x[2]).alias("total"))


@query("exceeds_threshold", "SELECT event_id, CAST(value > 120 AS INT) AS high FROM events")
def _(t):
    return t("events").select("event_id", scalar.exceeds("value", defaults.REGULATORY_THRESHOLD).alias("high"))


@query("classify_at", "SELECT doc_id, CAST(n_chars::DOUBLE / (n_chars + 1000)::DOUBLE >= 0.5 AS INT) AS predicted FROM documents")
def _(t):
    n = F.col("n_chars")
    return t("documents").select("doc_id", scalar.classify_at(n / (n + 1000.0), 0.5).alias("predicted"))


@query("time_range", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 24 HOURS AND TIMESTAMP '2024-01-10 12:00:00' + INTERVAL 3 DAYS")
def _(t):
    return cleaning.time_range(t("events"), "ts", "2024-01-10 12:00:00").select("event_id", "ts")


@query("rename", "SELECT event_id, 'value' AS variable, value FROM events UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE FROM events")
def _(t):
    df = t("events").select("event_id", F.col("user_id").cast("double").alias("user_id"), "value")
    return payloads.to_long(df, ["event_id"], ["value", "user_id"])


@query("hour_of", "SELECT event_id, CAST(hour(ts) AS INT) AS hour FROM events")
def _(t):
    return t("events").select("event_id", scalar.hour_of("ts").alias("hour"))


@query("weekday_of", "SELECT event_id, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events")
def _(t):
    return t("events").select("event_id", scalar.weekday_of("ts").alias("weekday"))


@query("month_of", "SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS month FROM orders")
def _(t):
    return t("orders").select("o_orderkey", scalar.month_of("o_orderdate").alias("month"))


@query("is_weekend", "SELECT event_id, CAST(isodow(ts) >= 6 AS INT) AS weekend FROM events")
def _(t):
    return t("events").select("event_id", scalar.is_weekend("ts").alias("weekend"))


@query("season_of", "SELECT o_orderkey, CAST((month(o_orderdate) % 12) // 3 AS INT) AS season FROM orders")
def _(t):
    return t("orders").select("o_orderkey", scalar.season_of("o_orderdate").alias("season"))


@query(
    "lookup_join",
    "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' "
    "WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season FROM orders",
)
def _(t):
    return t("orders").select("o_orderkey", scalar.lookup(F.month("o_orderdate"), defaults.SEASONS).alias("season"))


@query("cyclical_encode", "SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos FROM events")
def _(t):
    sin, cos = scalar.cyclical(scalar.hour_of("ts"), 24)
    return t("events").select("event_id", r(sin).alias("hour_sin"), r(cos).alias("hour_cos"))


@query(
    "bucketize",
    "SELECT event_id, CASE WHEN value BETWEEN 0 AND 30 THEN 'Low' WHEN value > 30 AND value <= 60 THEN 'Medium' "
    "WHEN value > 60 AND value <= 100 THEN 'High' END AS bucket FROM events",
)
def _(t):
    bucket = scalar.bucketize("value", defaults.HUMIDITY_EDGES, defaults.HUMIDITY_LABELS)
    return t("events").select("event_id", bucket.alias("bucket"))


@query("time_bucket", "SELECT event_id, CAST(floor(floor(epoch(ts)) / 180) AS BIGINT) AS bucket FROM events")
def _(t):
    return t("events").select("event_id", scalar.time_bucket("ts", 3).alias("bucket"))


@query("format_metric", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '—' ELSE printf('%.3f', value / 7) END AS shown FROM events")
def _(t):
    v = F.when(F.col("event_id") % 10 != 0, F.col("value") / 7)
    return t("events").select("event_id", scalar.format_metric(v).alias("shown"))


@query(
    "title_case",
    "SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(replace(lower(c_mktsegment) || '_' || c_name, '_', ' '), "
    "'([A-Za-z]+|[^A-Za-z]+)'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS title FROM customer",
)
def _(t):
    name = F.concat_ws("_", F.lower("c_mktsegment"), "c_name")
    return t("customer").select("c_custkey", scalar.title_case(name).alias("title"))


@query(
    "place_label",
    "SELECT c_custkey, c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ', ' || c_mktsegment END || ', ' || n_name || "
    "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' — (' || printf('%.4f', c_acctbal / 128) || ', ' || printf('%.4f', c_nationkey / 8.0) || ')' END AS place "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def _(t):
    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    area = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(F.lit(""))
    lat = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 128)
    label = scalar.place_label("c_name", area, "n_name", lat, F.col("c_nationkey") / 8.0)
    return df.select("c_custkey", label.alias("place"))


@query("to_date", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t):
    return t("events").select("event_id", scalar.to_date("ts").alias("day"))


@query(
    "standardize",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity, "
    "round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) + 0.0 AS l_discount FROM lineitem",
)
def _(t):
    cols = ["l_quantity", "l_discount"]
    df = t("lineitem").select("l_orderkey", "l_linenumber", *cols)
    return rounded(scaling.standardize(df, cols), *cols)


@query("scalar_broadcast", "SELECT event_id, round(value - avg(value) OVER (), 6) + 0.0 AS above_mean FROM events")
def _(t):
    events = t("events")
    mean = events.agg(F.avg("value")).scalar()
    return events.select("event_id", r(F.col("value") - mean).alias("above_mean"))


@query(
    "linspace",
    "SELECT event_type, CAST(i AS INT) AS i, round(CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END, 6) AS x "
    "FROM (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type), range(100) g(i)",
)
def _(t):
    spans = t("events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return scalar.linspace(spans, "lo", "hi", 100).select("event_type", "i", r("x").alias("x"))


def _poly_sql(coefs, x):
    out = repr(coefs[-1]) + "::DOUBLE"
    for c in reversed(coefs[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def normal_quantile_sql(p: str) -> str:
    """The same rational approximation as a DuckDB expression of a column ``p``."""
    d = distributions
    q, rr = f"({p} - 0.5)", f"sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END))"
    near, mid, far = f"(0.180625 - {q} * {q})", f"({rr} - 1.6)", f"({rr} - 5.0)"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly_sql(d.CENTRAL_NUM, near)} / {_poly_sql(d.CENTRAL_DEN, near)} "
        f"ELSE sign({q}) * CASE WHEN {rr} <= 5 THEN {_poly_sql(d.MIDDLE_NUM, mid)} / {_poly_sql(d.MIDDLE_DEN, mid)} "
        f"ELSE {_poly_sql(d.TAIL_NUM, far)} / {_poly_sql(d.TAIL_DEN, far)} END END"
    )


@query("normal_quantile", f"SELECT event_id, round({normal_quantile_sql('p')}, 6) + 0.0 AS z FROM (SELECT event_id, value / (value + 40::DOUBLE) AS p FROM events)")
def _(t):
    p = F.col("value") / (F.col("value") + 40.0)
    return t("events").select("event_id", r(distributions.normal_quantile(p)).alias("z"))
