import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.operators import cleaning


def raw(spark, n, **replace):
    start = dt.datetime(2004, 3, 10)
    rows = []
    for i in range(n):
        t = start + dt.timedelta(hours=i)
        rows.append((t.strftime("%d/%m/%Y"), t.strftime("%H.%M.%S"), 1.0 + i / (n - 1), 50.0 + 100 * i / (n - 1), 10.0 + 8 * i / (n - 1)))
    return spark.createDataFrame(rows, "Date string, Time string, CO_GT double, NO2_GT double, Temperature double")


def test_sentinel_is_interpolated(spark):
    df = raw(spark, 24).withColumn("CO_GT", F.when(F.col("Time") == "03.00.00", -200.0).otherwise(F.col("CO_GT")))
    out = cleaning.clean_series(df).orderBy("DateTime").collect()
    assert len(out) == 24
    assert out[2]["CO_GT"] < out[3]["CO_GT"] < out[4]["CO_GT"]


def test_sparse_column_dropped_and_types(spark):
    out = cleaning.clean_series(raw(spark, 20).withColumn("NMHC_GT", F.lit(-200)))
    assert "NMHC_GT" not in out.columns and "Date" not in out.columns and "Time" not in out.columns
    assert dict(out.dtypes)["DateTime"] == "timestamp_ntz"
    assert out.count() == 20


def test_sparse_is_strict(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 1.0), (None, None)], "half double, most double")
    assert cleaning.drop_sparse_columns(df).columns == ["half"]


def test_existing_datetime_kept_and_missing_raises(spark):
    df = spark.sql("SELECT timestamp_ntz'2004-03-10 00:00:00' AS DateTime, 1.0D AS x")
    assert cleaning.clean_series(df).count() == 1
    with pytest.raises(ValueError):
        cleaning.parse_datetime(df.select("x"))


def test_bad_dates_become_missing(spark):
    df = spark.createDataFrame([("31/02/2004", "01.00.00"), ("10/03/2004", "18.00.00"), (None, "01.00.00"), ("x", "y")], "Date string, Time string")
    got = [r["DateTime"] for r in cleaning.parse_datetime(df).collect()]
    assert got == [None, dt.datetime(2004, 3, 10, 18), None, None]


def test_dates_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("28/03/2004", "02.30.00")], "Date string, Time string")  # skipped hour in Rome
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
        out = cleaning.parse_datetime(df).select(F.col("DateTime").cast("string")).first()[0]
        bucket = cleaning.parse_datetime(df).select(scalar.epoch_seconds("DateTime")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert out == "2004-03-28 02:30:00"
    assert bucket == 1080441000


def test_coercion(spark):
    df = spark.createDataFrame([("1,5", "x"), ("-200", "2.25"), ("", "NaN"), (None, "1e3")], "a string, b string")
    got = [tuple(r) for r in cleaning.coerce_numeric(df).collect()]
    assert got == [(1.5, None), (-200.0, 2.25), (None, None), (None, 1000.0)]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 30, 30.1, 60, 100, 101)], "x double")
    labels = ["Low", "Medium", "High"]
    b = scalar.bucketize("x", [0, 30, 60, 100], labels)
    got = [r["b"] for r in df.select(b.alias("b")).collect()]
    assert got == [None, "Low", "Low", "Medium", "Medium", "High", None]
    ordinal = df.select(scalar.bucket_ordinal(b, labels).alias("o"))
    assert [r["o"] for r in ordinal.collect()] == [None, 0, 0, 1, 1, 2, None]


def test_text_functions(spark):
    df = spark.createDataFrame([(0.125, "mlp_deep2x run", "", "Lombardy", None, "45.46", "9.19")], "x double, n string, a string, b string, c string, lat string, lon string")
    r = df.select(
        scalar.format_metric("x").alias("m"),
        scalar.format_metric(F.lit(None)).alias("dash"),
        scalar.title_case("n").alias("t"),
        scalar.place_label("a", "b", "c", "lat", "lon").alias("p"),
        scalar.place_label("b", "a", "c", "a", "lon").alias("q"),
    ).first()
    assert r["m"] == f"{0.125:.3f}"
    assert r["dash"] == "—"
    assert r["t"] == "mlp_deep2x run".replace("_", " ").title()
    assert r["p"] == "Unknown, Lombardy — (45.4600, 9.1900)"
    assert r["q"] == "Lombardy"


def test_time_range_is_inclusive(spark):
    df = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-10 00:00:00', INTERVAL 1 HOUR)) AS ts")
    out = cleaning.time_range(df, "ts", "2024-01-03 12:00:00", forecast_days=2)
    lo, hi = out.selectExpr("min(ts)", "max(ts)").first()
    assert (lo, hi) == (dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 5, 12))


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = {r[0] for r in cleaning.sample_rows(df, 100, ["id"]).collect()}
    b = {r[0] for r in cleaning.sample_rows(df.repartition(7), 100, ["id"]).collect()}
    assert a == b and len(a) == 100
