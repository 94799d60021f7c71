import math

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import scalar
from gaugeflow.operators import features, scaling


@pytest.fixture(scope="module")
def clean(spark):
    return spark.sql(
        "SELECT timestamp_ntz'2004-03-10 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS DateTime, CAST(id + 1 AS DOUBLE) AS NO2_GT, "
        "5 + id * 20 / 47D AS Temperature, 40 + id * 40 / 47D AS Rel_Humidity FROM range(48)"
    )


def test_columns_and_values(clean):
    out = features.feature_frame(clean, threshold=10).orderBy("DateTime").collect()
    assert len(out) == 42
    names = "Hour DayOfWeek Month IsWeekend Season Hour_sin Hour_cos High_Pollution NO2_lag_1h NO2_lag_3h NO2_lag_6h NO2_roll_mean_3h NO2_roll_mean_6h"
    assert set(names.split()) <= set(out[0].asDict())
    for r in out:
        y = r["NO2_GT"]
        assert [r[f"NO2_lag_{k}h"] for k in (1, 3, 6)] == [y - 1, y - 3, y - 6]
        assert r["NO2_roll_mean_3h"] == pytest.approx(y - 2)  # rows y-3 .. y-1 only
        assert r["High_Pollution"] == int(y > 10)
        assert r["Hour_sin"] == pytest.approx(math.sin(2 * math.pi * r["Hour"] / 24))
    assert (out[0]["DayOfWeek"], out[0]["Season"], out[0]["IsWeekend"]) == (2, 1, 0)


def test_threshold_is_strict(clean):
    flags = {r["NO2_GT"]: r["High_Pollution"] for r in features.feature_frame(clean, threshold=20).collect()}
    assert flags[20.0] == 0 and flags[21.0] == 1


def test_targets_excluded(clean):
    cols = features.feature_columns(features.feature_frame(clean))
    assert not {"NO2_GT", "High_Pollution", "DateTime"} & set(cols)
    assert {"Temperature", "NO2_lag_1h", "Hour_cos"} <= set(cols)


def test_split(spark):
    df = spark.range(100).selectExpr("timestamp_ntz'2004-03-10 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS DateTime", "id AS value").repartition(7)
    for ratios, want in (((0.7, 0.15), (70, 15, 15)), ((0.6, 0.2), (60, 20, 20))):
        out = features.chronological_split(df, train_ratio=ratios[0], val_ratio=ratios[1])
        sets = {r["split"]: sorted(r["v"]) for r in out.groupBy("split").agg(F.collect_list("value").alias("v")).collect()}
        assert tuple(len(sets[s]) for s in ("train", "val", "test")) == want
        assert sets["train"] + sets["val"] + sets["test"] == list(range(100))
    parts = [out.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
    assert parts[0].unionAll(parts[1]).unionAll(parts[2]).exceptAll(df).isEmpty()


def test_split_of_tiny_tables(spark):
    for n in (0, 1, 2):
        df = spark.range(n).withColumnRenamed("id", "t")
        out = [r["split"] for r in features.chronological_split(df, ["t"]).orderBy("t").collect()]
        a, b = int(n * 0.7), int(n * 0.85)
        assert out == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)


def test_standardize_uses_population_deviation_and_train_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, k double")
    test = spark.createDataFrame([(4.0, 6.0)], "x double, k double")
    out = scaling.standardize(test, ["x", "k"], fit_on=train).first()
    assert out["x"] == pytest.approx((4 - 2) / math.sqrt(2 / 3))
    assert out["k"] == 1.0  # constant column: divided by one
    staged = scaling.scaler_stage(train, ["x", "k"]).transform(test).first()
    assert (staged["z_x"], staged["z_k"]) == pytest.approx((out["x"], out["k"]))


def test_assemble_rejects_missing(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "a int, b double, y int")
    row = features.assemble(df, ["a", "b"], "y").first()
    assert list(row["features"]) == [1.0, 2.0] and row["label"] == 3.0
    holes = spark.createDataFrame([(1, None, 3)], "a int, b double, y int")
    with pytest.raises(Exception):
        features.assemble(holes, ["a", "b"], "y").collect()


def test_grid(spark):
    grid = scalar.threshold_grid()
    assert len(grid) == 100 and grid[0] == 0.01 and grid[-1] == 0.99
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    assert [r["x"] for r in scalar.linspace(df, "a", "b", 5).orderBy("i").collect()] == [0, 0.25, 0.5, 0.75, 1]
