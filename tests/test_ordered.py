"""Block path against pandas, with a hot series, a hot timestamp, a missing key and long gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import cleaning, diagnostics, evaluation, features
from gaugeflow.plans import ordered as od

N = 900
ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    series = np.where(rng.random(N) < 0.4, "hot", rng.choice(["a", "b", "c", "d"], N)).astype(object)
    series[rng.random(N) < 0.05] = None
    ts = rng.integers(0, 300, N)
    ts[rng.random(N) < 0.34] = 7  # a default timestamp holds a third of the rows
    v = np.round(rng.normal(50, 20, N), 2)
    v[rng.random(N) < 0.2] = np.nan
    pdf = pd.DataFrame({"series": series, "ts": ts, "id": rng.permutation(N), "v": v, "w": np.round(rng.random(N), 3)})
    pdf = pdf.sort_values(["ts", "id"]).reset_index(drop=True)
    pdf.loc[200:330, "v"] = np.nan  # a gap longer than a block
    return pdf


@pytest.fixture(scope="module")
def sdf(spark, frame):
    rows = [tuple(None if x is None or x != x else x for x in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, "series string, ts long, id long, v double, w double").repartition(5).cache()


def groups(frame):
    for key, g in frame.fillna({"series": "?"}).sort_values(ORDER).groupby("series"):
        yield key, g


def assert_same(got, want, cols):
    g = got.toPandas().sort_values("id").reset_index(drop=True)
    w = want.sort_values("id").reset_index(drop=True)
    assert len(g) == len(w)
    for c in cols:
        np.testing.assert_allclose(g[c].astype(float), w[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("block_rows", [10_000, 300, 40, 5])
def test_lags_and_prior_means(sdf, frame, block_rows):
    parts = []
    for _, g in groups(frame):
        g = g.copy()
        for k in (1, 3, 6):
            g[f"l{k}"] = g["v"].shift(k)
        for n in (3, 6):
            g[f"m{n}"] = g["v"].rolling(n, min_periods=1).mean().shift(1)
        parts.append(g)
    o = od.order_rows(sdf, ORDER, ["series"], block_rows=block_rows)
    assert o.blocked == (block_rows < N)
    out = od.with_prior(o, "v", lags={"l1": 1, "l3": 3, "l6": 6}, means={"m3": 3, "m6": 6}).result()
    assert set(out.columns) == {*sdf.columns, "l1", "l3", "l6", "m3", "m6"}
    assert_same(out, pd.concat(parts), ["l1", "l3", "l6", "m3", "m6"])


@pytest.mark.parametrize("block_rows", [10_000, 100, 7])
def test_interpolation(sdf, frame, block_rows):
    parts = [g.assign(v=g["v"].interpolate(method="linear", limit=5)) for _, g in groups(frame)]
    out = cleaning.interpolate_linear(sdf, ["v", "w"], ORDER, ["series"], block_rows=block_rows)
    assert out.columns == sdf.columns
    assert_same(out, pd.concat(parts), ["v", "w"])


def test_interpolation_rules(spark):
    n = None
    given = [n, 1, n, n, 4, *[n] * 7, 12, n, 7, *[n] * 7]
    want = [n, 1, 2, 3, 4, 5, 6, 7, 8, 9, n, n, 12, 9.5, 7, 7, 7, 7, 7, 7, n, n]
    df = spark.createDataFrame([(i, float(x) if x is not None else None) for i, x in enumerate(given)], "i long, v double")
    for block_rows in (100, 4, 1):
        out = cleaning.interpolate_linear(df, ["v"], ["i"], block_rows=block_rows).orderBy("i").collect()
        assert [r["v"] for r in out] == want


def test_rolling_with_gap(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])), "i long, v double")
    for block_rows in (100, 2):
        out = features.rolling_mean_prior(df, "v", ["i"], windows=[3], block_rows=block_rows).orderBy("i")
        assert [r["v_roll_mean_3h"] for r in out.collect()] == [None, 1.0, 1.5, 1.5, 3.0, 4.5]


@pytest.mark.parametrize("block_rows", [10_000, 50])
def test_rank_and_running_totals(sdf, frame, block_rows):
    parts = []
    for _, g in groups(frame):
        parts.append(g.assign(rank=np.arange(1, len(g) + 1), n=len(g), cum=g["w"].cumsum(), total=g["w"].sum()))
    o = od.order_rows(sdf, ORDER, ["series"], block_rows=block_rows)
    ranked = od.with_rank(o, "rank", total="n")
    out = od.running_sums(ranked, {"cum": "w"}, {"total": "w"}).result()
    assert_same(out, pd.concat(parts), ["rank", "n", "cum", "total"])


@pytest.mark.parametrize("block_rows", [10_000, 64])
def test_global_order(sdf, frame, block_rows):
    g = frame.sort_values(ORDER)
    d = g["w"].diff()
    dw = (d**2).sum() / (g["w"] ** 2).sum()
    out = diagnostics.durbin_watson(sdf, "w", ORDER, block_rows=block_rows).first()[0]
    assert out == pytest.approx(dw)
    split = features.chronological_split(sdf, ORDER, block_rows=block_rows).toPandas().sort_values(ORDER)
    want = np.array(["train"] * int(N * 0.7) + ["val"] * (int(N * 0.85) - int(N * 0.7)) + ["test"] * (N - int(N * 0.85)))
    assert (split["split"].to_numpy() == want).all()


@pytest.mark.parametrize("block_rows", [10_000, 64])
def test_split_per_series(sdf, frame, block_rows):
    out = features.chronological_split(sdf, ORDER, ["series"], block_rows=block_rows).toPandas()
    for _, g in out.fillna({"series": "?"}).groupby("series"):
        n = len(g)
        assert (g["split"] == "train").sum() == int(n * 0.7)
        assert (g["split"] == "val").sum() == int(n * 0.85) - int(n * 0.7)


def test_blocks_are_ordered_and_bounded(sdf):
    o = od.order_rows(sdf, ORDER, [], block_rows=50)
    spans = o.df.groupBy(od.BLK).agg(F.min(F.struct(*ORDER)).alias("lo"), F.max(F.struct(*ORDER)).alias("hi"), F.count("*").alias("n"))
    rows = sorted(spans.collect(), key=lambda r: r[od.BLK])
    assert len(rows) > 9
    assert all(tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(rows, rows[1:]))
    assert max(r["n"] for r in rows) < 250  # although one timestamp holds a third of all rows


def test_plan_shuffles_series_once(sdf):
    from gaugeflow.plans.ordered import order_rows, with_prior

    out = with_prior(order_rows(sdf, ORDER, ["series"]), "v", lags={"l1": 1}, means={"m3": 3}).result()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_order_statistics(sdf, frame):
    for c in ("v", "w", "ts"):
        known = np.sort(frame[c].dropna().to_numpy(float))
        ranks = [0, 5, len(known) // 2, len(known) - 1]
        for bins in (4, 4096):
            got = od.order_statistics(sdf, {c: ranks}, bins=bins)
            assert [got[(c, k)] for k in ranks] == [known[k] for k in ranks]
    counts = {c: int(frame[c].notna().sum()) for c in ("v", "w", "ts")}
    medians = od.exact_medians(sdf, list(counts))
    assert all(medians[c] == pytest.approx(frame[c].median()) for c in counts)


@pytest.mark.parametrize(
    "values, median",
    [
        ([1.0, 2.0, 3.0, float("nan")], 2.0),
        ([1.0, float("inf")], float("inf")),
        ([float("-inf"), 1.0, 2.0, float("inf")], 1.5),
        ([float("-inf"), float("-inf"), 7.0, float("inf"), float("inf")], 7.0),
        ([-1.5e308, 1.5e308, 5.0], 5.0),
        ([1.5e308, 1.7e308], 1.6e308),
        ([5e-324, 0.0, 1e-323], 5e-324),
        ([1e-300, 1e300, 1.0, 2.0], 1.5),
        ([4.0] * 9, 4.0),
        ([None, None], None),
        ([float("nan")], None),
        ([], None),
    ],
)
def test_medians_always_end(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert od.exact_medians(df, ["x"])["x"] == median


def test_curves_in_blocks_equal_plain(sdf):
    df = sdf.withColumn("y", (F.col("id") % 3 == 0).cast("int")).withColumn("p", F.round("w", 2))
    for group in ([], ["series"]):
        plain = evaluation.curve_areas(df.na.drop(subset=["series"]), "y", "p", group)
        blocked = evaluation.curve_areas(df.na.drop(subset=["series"]), "y", "p", group, block_rows=20)
        a = {tuple(r[:-2]): r[-2:] for r in plain.collect()}
        b = {tuple(r[:-2]): r[-2:] for r in blocked.collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert b[k] == pytest.approx(a[k])
