import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import supervised
from gaugeflow.plans import defaults
from gaugeflow.sources import delimited, payloads, tables


def test_schema_error_names_the_source(spark):
    df = spark.createDataFrame([("a", "b")], "Date string, Time string")
    with pytest.raises(delimited.SchemaError) as e:
        delimited.validate_schema(df, source="sensor.csv")
    assert "sensor.csv is missing required columns" in str(e.value) and "NO2_GT" in str(e.value)
    assert issubclass(delimited.SchemaError, ValueError)
    delimited.validate_schema(df.select("*", *[F.lit(1).alias(c) for c in defaults.REQUIRED_COLUMNS[2:]]))


def test_decimal_commas_and_trailing_separators(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Date;Time;CO_GT;T;;\n10/03/2004;18.00.00;2,6;13.6;;\n10/03/2004;19.00.00;-200;x;;\n")
    df = delimited.read_delimited(spark, str(tmp_path / "raw.csv"))
    assert df.columns == ["Date", "Time", "CO_GT", "T"]
    assert [tuple(r) for r in df.collect()] == [("10/03/2004", "18.00.00", 2.6, 13.6), ("10/03/2004", "19.00.00", -200.0, None)]


def test_fallback_is_stored_once(spark, tmp_path):
    path, made = str(tmp_path / "deep" / "raw"), []

    def fallback():
        made.append(1)
        return spark.createDataFrame([("10/03/2004", "18.00.00", 1.5)], "Date string, Time string, x double")

    for _ in range(2):
        df = delimited.load_or_else(spark, path, lambda p: delimited.read_delimited(spark, p), fallback)
        assert [tuple(r) for r in df.collect()] == [("10/03/2004", "18.00.00", 1.5)]
    assert made == [1]


def test_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "c,d")], "x int, y string")
    delimited.write_delimited(df, str(tmp_path / "a" / "t"))
    assert sorted(delimited.read_table(spark, str(tmp_path / "a" / "t")).collect()) == sorted(df.collect())


def test_metrics_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", float("nan"), 2.0)], "model string, x double, y double")
    tables.write_metrics(df, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    assert '"y":null' in text and '"x":"NaN"' in text
    got = {r["model"]: r for r in tables.read_metrics(spark, str(tmp_path / "m"), "model string, x double, y double").collect()}
    assert got["a"]["y"] is None and math.isnan(got["b"]["x"])
    (tmp_path / "lit.json").write_text('{"model": "c", "x": NaN, "y": 1}\n')
    assert math.isnan(tables.read_metrics(spark, str(tmp_path / "lit.json"), "model string, x double, y double").first()["x"])


def test_stage_tables(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2004-03-10 18:00:00' AS ts, 1.0D AS v UNION ALL SELECT timestamp_ntz'2004-04-01 00:00:00', 2.0D")
    tables.write_stage_tables({"cleaned": df, "train": df.limit(1)}, str(tmp_path), "ts")
    back = tables.read_stage_tables(spark, str(tmp_path), ["cleaned", "train"])
    assert sorted(back["cleaned"].select("ts", "v").collect()) == sorted(df.collect()) and back["train"].count() == 1
    assert {p.name for p in (tmp_path / "cleaned").glob("month*")} == {"month_key=2004-03", "month_key=2004-04"}


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    model = supervised.fit_linear_regression(df, ["x"], "y")
    tables.save_model(model, str(tmp_path / "m"))
    got = supervised.predict(tables.load_model(str(tmp_path / "m")), df).collect()
    assert all(r["prediction"] == pytest.approx(r["y"]) for r in got)


def docs(spark, *payload):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payload)], "i int, j string")


def test_hourly_rows_with_missing_variable(spark):
    p = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None]}}
    df = docs(spark, p, {"hourly": {"time": []}}, {"other": 1})
    out = payloads.hourly_payload_to_rows(df, "j", ["temperature_2m", "wind"], ["i"]).orderBy("time").collect()
    assert [tuple(r) for r in out] == [(0, dt.datetime(2024, 1, 1, 0), 1.5, None), (0, dt.datetime(2024, 1, 1, 1), None, None)]
    assert payloads.to_series(payloads.hourly_payload_to_rows(df, "j", ["wind"]), "wind").columns == ["time", "value"]


def test_daily_rows(spark):
    df = docs(spark, {"daily": {"time": ["2024-02-29"], "rain": [3]}})
    assert tuple(payloads.daily_payload_to_rows(df, "j", ["rain"]).first()) == (dt.date(2024, 2, 29), 3.0)


def test_current(spark):
    df = docs(spark, {"current": {"time": "2024-01-01T00:15", "temperature_2m": 7.4, "wind_speed_10m": 3}, "current_units": {"temperature_2m": "°C"}})
    got = {r["variable"]: r["reading"] for r in payloads.current_conditions(df, "j").collect()}
    assert got == {"Temperature": "7.4 °C", "Wind Speed": "3", "Time": "2024-01-01T00:15"}


def test_geocode_and_errors(spark):
    df = docs(spark, {"results": [{"name": "Milan", "latitude": 45.4, "longitude": 9.1}, {"name": "x", "latitude": 1}]}, {"x": 1})
    assert [r["name"] for r in payloads.geocode_matches(df, "j").collect()] == ["Milan"]
    good, bad = payloads.split_payloads(docs(spark, {"error": True, "reason": "r"}, {"error": False}, {"error": True}, {}), "j")
    assert {r["i"] for r in good.collect()} == {1, 3}
    assert {r["i"]: r["reason"] for r in bad.collect()} == {0: "r", 2: payloads.DEFAULT_REASON}
