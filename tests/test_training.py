"""Smoke test: 700 made-up hours through every stage, with small estimators."""

import datetime as dt

import numpy as np
import pytest

from gaugeflow.plans import defaults
from gaugeflow.plans.training import Run, Sizes
from gaugeflow.sources import delimited


def raw_hours(n=700):
    rng = np.random.default_rng(42)
    start, rows, no2 = dt.datetime(2004, 3, 10, 18), [], 100.0
    for i in range(n):
        t = start + dt.timedelta(hours=i)
        load = np.sin(2 * np.pi * (t.hour - 8) / 24)
        no2 = 0.6 * no2 + 0.4 * (110 + 40 * load) + rng.normal(0, 8)
        row = {
            "Date": t.strftime("%d/%m/%Y"), "Time": t.strftime("%H.%M.%S"),
            "CO_GT": round(2 + load + rng.normal(0, 0.2), 1), "NMHC_GT": -200, "C6H6_GT": round(10 + 3 * load + rng.normal(), 1),
            "NOx_GT": int(200 + 80 * load + rng.normal(0, 10)), "NO2_GT": int(no2), "Temperature": round(15 + 6 * load + rng.normal(), 1),
            "Rel_Humidity": round(50 - 15 * load + rng.normal(0, 5), 1), "Abs_Humidity": round(1 + 0.1 * rng.normal(), 4),
        }
        for c in defaults.SENSOR_COLUMNS:
            row[c] = int(1000 + 200 * load + rng.normal(0, 40))
        if i % 37 == 5:
            row["CO_GT"] = row["NO2_GT"] = -200
        rows.append(row)
    return rows


def test_whole_run(spark, tmp_path):
    cols = [*defaults.REQUIRED_COLUMNS, "NMHC_GT"]
    text = [";".join([*cols, "", ""])] + [";".join([*(str(r[c]).replace(".", "," if c not in ("Date", "Time") else ".") for c in cols), "", ""]) for r in raw_hours()]
    (tmp_path / "raw.csv").write_text("\n".join(text) + "\n")
    raw = delimited.read_delimited(spark, str(tmp_path / "raw.csv"), required=defaults.REQUIRED_COLUMNS)
    sizes = Sizes(
        forest=dict(trees=5, depth=5), random_threshold=dict(trees=4, depth=5), boosting=dict(depth=3, iterations=3),
        kmeans=dict(k=4, restarts=2, max_iter=10), gmm=dict(k=4, restarts=1, max_iter=5), hierarchical=dict(k=4, micro=30),
        mlp={"mlp": dict(hidden=(8,), epochs=3)},
    )
    out = Run(str(tmp_path / "out"), sizes=sizes, block_rows=250).everything(raw)
    assert out["features"].count() == 694 and "NMHC_GT" not in out["features"].columns
    assert [out[s].count() for s in ("train", "val", "test")] == [int(694 * 0.7), int(694 * 0.85) - int(694 * 0.7), 694 - int(694 * 0.85)]
    assert out["column_statistics"].count() == 23
    reg = {r["model"]: r for r in out["regression_metrics"].collect()}
    assert set(reg) == {"linear_regression", "random_forest_reg", "extra_trees_reg", "hist_gradient_boosting_reg", "mlp_regression"}
    assert reg["linear_regression"]["r2"] > 0.5
    clf = {r["model"]: r for r in out["classification_metrics"].collect()}
    assert all(0 <= r["roc_auc"] <= 1 for r in clf.values()) and clf["logistic_regression"]["roc_auc"] > 0.8
    assert {r["model"] for r in out["clustering_metrics"].collect()} == {"kmeans", "gmm", "agglomerative", "dbscan"}
    assert out["model_comparison"].count() == 10 and out["threshold_sweep"].count() == 500
    assert 0 < out["residual_diagnostics"].first()["durbin_watson"] < 4
    assert out["two_sample_ttest"].first()["p_value"] == pytest.approx(0, abs=1) and out["cluster_view"].count() == 694
