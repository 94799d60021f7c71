"""Queries whose meaning depends on row order, and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.columns import normal_quantile_sql
from gaugeflow.catalog.registry import FILL_SQL, GAPS_SQL, LINE_SCORES_SQL, SERIES_SQL, query, r, rounded
from gaugeflow.operators import cleaning, diagnostics, evaluation, features
from gaugeflow.plans.ordered import fill_linear, order_rows

ORDER, SERIES = ["ts", "event_id"], ["event_type"]


@query("interpolate_linear", f"WITH {GAPS_SQL}, {FILL_SQL} SELECT event_type, event_id, round(x, 6) AS v FROM c")
def _(t):
    out = cleaning.interpolate_linear(t.gaps(), ["v"], ORDER, SERIES)
    return out.select("event_type", "event_id", r("v").alias("v"))


@query(
    "lag_features",
    "SELECT event_id, lag(value, 1) OVER w AS value_lag_1h, lag(value, 3) OVER w AS value_lag_3h, lag(value, 6) OVER w AS value_lag_6h "
    "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)",
)
def _(t):
    out = features.lag_features(t("events").drop("props", "user_id"), "value", ORDER, SERIES)
    return out.select("event_id", *[f"value_lag_{k}h" for k in (1, 3, 6)])


@query(
    "rolling_mean_prior",
    f"WITH {GAPS_SQL} SELECT event_id, round(avg(v) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS v_roll_mean_3h, "
    "round(avg(v) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 6) AS v_roll_mean_6h FROM s",
)
def _(t):
    out = features.rolling_mean_prior(t.gaps(), "v", ORDER, SERIES)
    return out.select("event_id", r("v_roll_mean_3h").alias("v_roll_mean_3h"), r("v_roll_mean_6h").alias("v_roll_mean_6h"))


@query(
    "first_difference",
    "SELECT event_id, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) + 0.0 AS difference FROM events",
)
def _(t):
    out = features.first_difference(t("events"), "value", ORDER, SERIES)
    return out.select("event_id", r("difference").alias("difference"))


@query(
    "chronological_split",
    "SELECT event_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split "
    "FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)",
)
def _(t):
    return features.chronological_split(t("events").select("event_id", "ts"), ORDER).select(
        "event_id", "split"
    )


@query(
    "running_totals",
    f"WITH {LINE_SCORES_SQL}, g AS (SELECT model, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY ALL) "
    "SELECT model, round(score, 9) AS score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp "
    "FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
)
def _(t):
    cum = evaluation.running_totals(t.line_scores(), "y", "p", ["model"]).result()
    return cum.select("model", r("score", 9).alias("score"), "tp", "fp")


FILLIBEN = (
    "SELECT event_id, rn, value, CASE WHEN rn = 1 THEN 1 - pow(0.5, 1.0::DOUBLE / n) WHEN rn = n THEN pow(0.5, 1.0::DOUBLE / n) "
    "ELSE (rn - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p "
    "FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS rn, count(*) OVER () AS n FROM events)"
)


@query("qq_points", f"SELECT event_id, rn AS rank, value AS ordered_value, round({normal_quantile_sql('p')}, 6) + 0.0 AS theoretical FROM ({FILLIBEN})")
def _(t):
    out = diagnostics.qq_points(t("events"), "value", ["event_id"])
    return out.select("event_id", F.col("rank").cast("long").alias("rank"), "ordered_value", r("theoretical").alias("theoretical"))


FEATURES_CTE = f"""{SERIES_SQL.replace("-200.0", "NULL")}, {FILL_SQL},
d AS (SELECT * FROM c WHERE x IS NOT NULL),
f AS (SELECT event_type, event_id, ts, x, CAST(hour(ts) AS INT) AS hr, CAST(isodow(ts) - 1 AS INT) AS dow,
  CAST((month(ts) % 12) // 3 AS INT) AS season, CAST(x > 120 AS INT) AS high,
  lag(x, 1) OVER w AS lag1, lag(x, 3) OVER w AS lag3, lag(x, 6) OVER w AS lag6,
  avg(x) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r3,
  avg(x) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS r6
  FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""
FEATURES_SQL = f"""WITH {FEATURES_CTE} SELECT event_type, event_id, round(x, 6) AS x, hr, dow, season, high, round(sin(2 * pi() * hr / 24), 6) + 0.0 AS hs,
  round(lag1, 6) AS lag1, round(lag3, 6) AS lag3, round(lag6, 6) AS lag6, round(r3, 6) AS r3, round(r6, 6) AS r6
FROM f WHERE lag6 IS NOT NULL"""


def features_of(t):
    """Cleaned series with every feature, keeping the row order (and shuffle) throughout."""
    typed = cleaning.sentinel_to_null(t.series(), cols=["v"])
    o = fill_linear(order_rows(typed, ORDER, SERIES, rows=t("events").count()), ["v"], 5)
    o = o.on(o.df.filter(F.col("v").isNotNull()))
    return features.feature_frame(o, value_col="v", ts_col="ts", prefix="v")


@query("feature_frame", FEATURES_SQL)
def _(t):
    out = features_of(t).select(
        "event_type", "event_id", F.col("v").alias("x"), F.col("Hour").alias("hr"), F.col("DayOfWeek").alias("dow"),
        F.col("Season").alias("season"), F.col("High_Pollution").alias("high"), F.col("Hour_sin").alias("hs"),
        *[F.col(f"v_lag_{k}h").alias(f"lag{k}") for k in (1, 3, 6)],
        *[F.col(f"v_roll_mean_{n}h").alias(f"r{n}") for n in (3, 6)],
    )
    return rounded(out, "x", "hs", "lag1", "lag3", "lag6", "r3", "r6")


@query(
    "clean_series",
    f"WITH {SERIES_SQL.replace('-200.0', 'NULL')}, {FILL_SQL} "
    "SELECT event_type, event_id, date_trunc('second', ts) AS ts, round(x, 6) AS v FROM c WHERE x IS NOT NULL",
)
def _(t):
    raw = t.series().select(
        "event_type", "event_id", F.date_format("ts", "dd/MM/yyyy").alias("Date"),
        F.date_format("ts", "HH.mm.ss").alias("Time"), "v", F.lit(-200.0).alias("NMHC_GT"),
    )
    out = cleaning.clean_series(raw, order_cols=["DateTime", "event_id"], partition_cols=SERIES)
    return out.select(*[c for c in out.columns if c != "DateTime"], F.col("DateTime").alias("ts")).withColumn("v", r("v"))


@query("sort_chronological", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def _(t):
    return cleaning.sort_chronological(t("events").select("event_id", "ts", "value"), ORDER)


@query("sample_rows", "SELECT event_id, value FROM events ORDER BY md5(event_id || '|42'), event_id LIMIT 5000")
def _(t):
    return cleaning.sample_rows(t("events").select("event_id", "value"), 5000, ["event_id"])
