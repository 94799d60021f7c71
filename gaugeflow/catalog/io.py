"""Sources and sinks: tables go out to the shared folder and come back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.ordered_rows import FEATURES_CTE, ORDER, features_of
from gaugeflow.catalog.registry import query, r, rounded
from gaugeflow.functions import scalar
from gaugeflow.operators import cleaning, evaluation, features, supervised
from gaugeflow.session import scratch_path
from gaugeflow.sources import delimited, payloads, tables


def _raw_text(t):
    """Events as the delimited file has them: day-first text, decimal commas, a blank column."""
    value = F.when(F.col("event_id") % 40 == 0, F.lit("n/a")).otherwise(
        F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))
    )
    return t("events").select(
        F.date_format("ts", "dd/MM/yyyy").alias("Date"), F.date_format("ts", "HH.mm.ss").alias("Time"),
        F.col("event_id").cast("string").alias("event_id"), value.alias("value"),
        F.lit(None).cast("string").alias("Unnamed: 4"),
    )


RAW_SQL = "SELECT event_id, date_trunc('second', ts) AS \"DateTime\", CASE WHEN event_id % 40 <> 0 THEN value END AS value FROM events"


@query("read_delimited", RAW_SQL)
def _(t):
    path = scratch_path(t.spark, "raw")
    delimited.write_delimited(_raw_text(t), path, sep=";")
    df = delimited.read_delimited(t.spark, path, required=["Date", "Time", "value"])
    return cleaning.parse_datetime(df).withColumn("event_id", F.col("event_id").cast("long"))


@query("load_or_else", RAW_SQL)
def _(t):
    path = scratch_path(t.spark, "fallback")
    df = delimited.load_or_else(t.spark, path, lambda p: delimited.read_delimited(t.spark, p), lambda: _raw_text(t))
    return cleaning.parse_datetime(df).withColumn("event_id", F.col("event_id").cast("long"))


@query("drop_unnamed", "SELECT event_id, value FROM events")
def _(t):
    df = t("events").select("event_id", "value", F.lit(None).alias("_c2"), F.lit(None).alias("Unnamed: 3"))
    return delimited.drop_unnamed(df)


@query("coerce_numeric", "SELECT event_id::DOUBLE AS event_id, CASE WHEN event_id % 40 <> 0 THEN value END AS value FROM events")
def _(t):
    return delimited.coerce_numeric(_raw_text(t).select("event_id", "value"))


@query("validate_schema", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(t):
    df = t("lineitem")
    delimited.validate_schema(df, source="lineitem", required=["l_orderkey", "l_linenumber", "l_returnflag"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("write_delimited", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(t):
    path = scratch_path(t.spark, "orders")
    delimited.write_delimited(t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return delimited.read_table(t.spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")


@query("read_table", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = scratch_path(t.spark, "customer")
    delimited.write_delimited(t("customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return delimited.read_table(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query(
    "write_stage_tables",
    f"WITH {FEATURES_CTE}, k AS (SELECT event_type, ts, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM f WHERE lag6 IS NOT NULL) "
    "SELECT event_type, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS stage, "
    "count(*) AS n, min(ts) AS first_ts FROM k GROUP BY ALL",
)
def _(t):
    folder = scratch_path(t.spark, "stages")
    feat = features_of(t)
    tables.write_stage_tables({"features": feat}, folder)
    split = features.chronological_split(t.spark.read.parquet(f"{folder}/features"), ORDER)
    parts = {name: split.filter(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
    tables.write_stage_tables(parts, folder, "ts")
    stored = tables.read_stage_tables(t.spark, folder, list(parts))
    out = None
    for name, df in stored.items():
        one = df.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts")).withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _stored_metrics(t):
    path = scratch_path(t.spark, "metrics")
    found = evaluation.regression_metrics(t.fits(), "y", "pred", ["model"])
    share = F.when(F.col("model") == "A", F.lit(float("nan"))).otherwise(F.lit(0.5))
    tables.write_metrics(found.withColumn("noise_ratio", share), path)
    out = tables.read_metrics(t.spark, path, "model string, rmse double, mae double, r2 double, noise_ratio double")
    return rounded(rounded(out, "rmse", "mae", digits=4), "r2")


METRICS_SQL = (
    "SELECT l_returnflag AS model, round(sqrt(avg((l_extendedprice - l_quantity * 1500::DOUBLE) ** 2)), 4) AS rmse, "
    "round(avg(abs(l_extendedprice - l_quantity * 1500::DOUBLE)), 4) AS mae, "
    "round(1 - avg((l_extendedprice - l_quantity * 1500::DOUBLE) ** 2) / var_pop(l_extendedprice), 6) AS r2{more} FROM lineitem GROUP BY 1"
)


@query("write_metrics", METRICS_SQL.format(more=""))
def _(t):
    return _stored_metrics(t).drop("noise_ratio")


@query("read_metrics", METRICS_SQL.format(more=", CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_nan"))
def _(t):
    return _stored_metrics(t).withColumn("is_nan", F.isnan("noise_ratio").cast("int")).drop("noise_ratio")


LINE_SQL = (
    "SELECT l_orderkey, l_linenumber, round((SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity + "
    "(SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem), 4) AS prediction FROM lineitem"
)


def _line(t):
    return supervised.fit_linear_regression(t("lineitem"), ["l_quantity"], "l_extendedprice")


def _scored(t, model):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return supervised.predict(model, df).drop("l_quantity").withColumn("prediction", r("prediction", 4))


@query("save_model", LINE_SQL)
def _(t):
    path = scratch_path(t.spark, "model")
    tables.save_model(_line(t), path)
    return _scored(t, tables.load_model(path))


@query(
    "load_model",
    "SELECT l_orderkey, l_linenumber, round(avg(CAST(l_quantity > 25 AS INT)) OVER (PARTITION BY l_returnflag = 'R'), 6) AS score FROM lineitem",
)
def _(t):
    # a classifier that parts the two values of its one feature: its score is the share of each side
    df = t("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("returned"), scalar.exceeds("l_quantity", 25).alias("many")
    )
    path = scratch_path(t.spark, "classifier")
    tables.save_model(supervised.fit_random_threshold_forest(df, ["returned"], "many", task="classification", trees=20), path)
    return supervised.predict(tables.load_model(path), df).select("l_orderkey", "l_linenumber", r("score").alias("score"))


@query("fit_linear_regression", LINE_SQL)
def _(t):
    return _scored(t, _line(t))


# ---------------------------------------------------------------- payloads


def _stamp(hours: int):
    return F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm")


def weather(t):
    """One forecast document per event: three hourly and two daily entries, current readings."""
    v = F.col("value")
    hourly = F.struct(
        F.array(_stamp(0), _stamp(1), _stamp(2)).alias("time"),
        F.array(v, v + 1, F.lit(None).cast("double")).alias("temperature_2m"),
    )
    days = F.array(F.date_format("ts", "yyyy-MM-dd"), F.date_format(F.date_add("ts", 1), "yyyy-MM-dd"))
    daily = F.struct(days.alias("time"), F.array(v, v * 2).alias("temperature_2m_max"))
    current = F.struct(_stamp(0).alias("time"), v.alias("temperature_2m"), F.col("user_id").alias("relative_humidity_2m"))
    units = F.struct(F.lit("°C").alias("temperature_2m"), F.lit("%").alias("relative_humidity_2m"))
    bad = F.when(F.col("event_id") % 25 == 0, F.lit(True))
    reason = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("no data for user "), F.col("user_id")))
    place = F.array(
        F.struct(F.col("event_type").alias("name"), v.alias("latitude"), (v / 2).alias("longitude")),
        F.struct(F.lit("nowhere").alias("name"), v.alias("latitude"), F.lit(None).cast("double").alias("longitude")),
    )
    doc = F.struct(
        hourly.alias("hourly"), daily.alias("daily"), current.alias("current"), units.alias("current_units"),
        bad.alias("error"), reason.alias("reason"), place.alias("results"),
    )
    return t("events").select("event_id", F.to_json(doc).alias("payload"))


HOURLY_SQL = (
    "SELECT event_id, date_trunc('minute', ts) + INTERVAL 1 HOUR * i AS time, CASE i WHEN 0 THEN value WHEN 1 THEN value + 1 END AS temperature_2m, "
    "NULL::DOUBLE AS wind_speed_10m FROM events, range(3) g(i)"
)


@query("hourly_payload_to_rows", HOURLY_SQL)
def _(t):
    return payloads.hourly_payload_to_rows(weather(t), "payload", ["temperature_2m", "wind_speed_10m"], ["event_id"])


@query("daily_payload_to_rows", "SELECT event_id, CAST(CAST(ts AS DATE) + CAST(i AS INT) AS DATE) AS date, CASE i WHEN 0 THEN value ELSE value * 2 END AS temperature_2m_max FROM events, range(2) g(i)")
def _(t):
    return payloads.daily_payload_to_rows(weather(t), "payload", ["temperature_2m_max"], ["event_id"])


@query(
    "current_conditions",
    "SELECT event_id, 'Humidity' AS variable, user_id::VARCHAR || ' %' AS reading FROM events UNION ALL "
    "SELECT event_id, 'Temperature', value::VARCHAR || ' °C' FROM events UNION ALL "
    "SELECT event_id, 'Time', strftime(ts, '%Y-%m-%dT%H:%M') FROM events",
)
def _(t):
    return payloads.current_conditions(weather(t), "payload", ["event_id"])


@query("geocode_matches", "SELECT event_id, event_type AS name, value AS latitude, value / 2 AS longitude FROM events")
def _(t):
    return payloads.geocode_matches(weather(t), "payload", ["event_id"]).drop("admin1", "country")


@query("payload_errors", "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'no data for user ' || user_id ELSE 'Open-Meteo error' END AS reason FROM events WHERE event_id % 25 = 0")
def _(t):
    _, rejected = payloads.split_payloads(weather(t), "payload")
    return rejected.drop("payload")
