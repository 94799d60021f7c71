"""The quality classifier: gradients, held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np
import pytest

from gaugeflow.llm import passage_quality as pq
from gaugeflow.llm import queries
from tests.llm.fixtures import odd_documents, odd_texts, prose, without_rows


def test_description_of_passages():
    texts = [b"", b"Ab, " * 600, "é".encode() * 10, b"x" * pq.PASSAGE]
    x, counts = pq.describe(texts)
    assert counts.tolist() == [1, 3, 1, 1] and x.shape == (6, pq.WIDTH) and x.dtype == np.float32
    assert not x[0].any()
    ones = x[:, pq.CLASSES**2 : pq.CLASSES**2 + pq.CLASSES] ** 2
    assert np.allclose(ones[1:].sum(axis=1), 1, atol=1e-5)
    assert np.allclose(ones[1][[0, 1, 3, 6]], 0.25)
    again = x[:, -2]
    assert again[2] > 0.9 and again[1] > 0.9 and again[5] > 0.9 and again[4] == pytest.approx(3 / 20)
    alone, _ = pq.describe([texts[1]])
    assert np.allclose(alone, x[1:4], atol=1e-6)  # a text's passages do not depend on its neighbours


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    counts, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(6, pq.WIDTH))
    network = pq.Network(np.full(pq.WIDTH, 0.1), np.full(pq.WIDTH, 2.0))
    flat = network.start(3) + rng.normal(0, 0.1, len(network.start(3)))
    total, _, n = network.gradient(flat, x, counts, y)
    assert n == 3
    for at in [*rng.integers(0, len(flat), 25), *range(len(flat) - 40, len(flat))]:
        step = np.zeros_like(flat)
        step[at] = 1e-6
        up, down = network.gradient(flat + step, x, counts, y)[1], network.gradient(flat - step, x, counts, y)[1]
        assert total[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_attention_finds_the_telling_passage(spark):
    """Labels follow one passage among many; the attention it gets exceeds an even share."""
    good = [prose(s, 900) for s in range(150)]
    bad = [t[:3000] + " # $ % | " * 120 + t[3000:] for t in (prose(500 + s, 900) for s in range(150))]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id long, quality int")
    model = pq.fit_passage_quality(docs, labels, steps=60)
    assert model.losses[-1] < 0.2 * model.losses[0]
    x, counts = pq.describe([bad[0].encode()])
    attention = model.network.forward(model.weights, x, counts)["a"]
    assert attention.argmax() in (2, 3) and attention.max() > 1.5 / counts[0]
    scores = {r.doc_id: r.score for r in model.scored(docs).collect()}
    assert all((scores[i] >= 0.5) == (i < 150) for i in scores if zlib.crc32(str(i).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op11_quality_classifier"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(got[i].score, q) for i, q in labels.items() if got[i].held_out]
    high, low = ([s for s, q in held if q == k] for k in (1, 0))
    assert len(low) > 100
    area = np.mean([(a > b) + (a == b) / 2 for b in low for a in high])
    kept, caught = np.mean([s >= 0.7 for s in high]), np.mean([s < 0.7 for s in low])
    print("area", area, "kept", kept, "caught", caught)
    assert area > 0.97 and kept > 0.97 and caught > 0.9


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, prose(i, 60) + (" ###" * (i % 2))) for i in range(200)], "doc_id long, text string")
    right = [(i, i % 2) for i in range(200)]
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in right]
    first, second = (
        pq.fit_passage_quality(docs, spark.createDataFrame(x, "doc_id long, quality int"), steps=5).weights for x in (right, wrong)
    )
    assert np.array_equal(first, second)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(1, 0, 0), (1, 1, 0), (6, 1, 1), (7, None, None), (None, 1, 0), (23, 0, 0), (10**9, 1, 0)], "doc_id long, quality int, text int"
    )
    rows = queries.op11(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in odd_texts())
    assert all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[1] == pytest.approx(by_id[2]) == pytest.approx(by_id[21])  # missing and empty texts
    big = docs.sparkSession.createDataFrame([(2**60 + 1, "a"), (None, "b"), (2**60 + 1, None)], "doc_id long, text string")
    got = queries.op11(big, labels).collect()
    assert sorted((r.doc_id or 0 for r in got)) == [0, 2**60 + 1, 2**60 + 1]
    assert {r.score for r in got} == {0.5}  # none of these ids is labelled
    assert queries.op11(without_rows(spark), labels).count() == 0
    assert {r.score for r in queries.op11(docs, labels.filter("false")).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert 300 < pq._drawn(docs, 400, "doc_id", "text").count() < 500
    assert pq._drawn(docs, 4000, "doc_id").count() == 4000
