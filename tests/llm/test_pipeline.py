"""The pipeline on odd rows, on no rows, and stage by stage against plain checks."""

import corpus_pipeline as pipeline
from gaugeflow.llm import personal
from gaugeflow.llm.common import staged
from tests.llm.fixtures import odd_documents, prose, without_rows
from tests.llm.test_operators import plain_ids, plain_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns(spark):
    docs = odd_documents(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, ""), "test")
        assert out.columns == docs.columns, name
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_no_rows(spark):
    docs = without_rows(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_with_missing_and_repeated_ids(spark):
    good, bad = [prose(i, 200) for i in range(40, 46)], "too short"
    marked = [f"{t} mail a{k}@b.example.com or 10.1.2.3" for k, t in enumerate(good)]
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, t, "en", "s") for i in (None, 7) for t in (*good[:3], bad)]
    kept = pipeline.quality_rules(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(r.text for r in kept) == sorted(2 * good[:3])

    rows = [(None, good[0], "en", "s")] * 3 + [(7, good[1], "en", "s")] * 3 + [(7, good[2], "fr", "s"), (8, good[2], "en", "s")]
    rows += [(None, good[3], "en", "s"), (5, good[3], "en", "s"), (None, good[4], "en", "s"), (7, good[5], "en", "s")]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(r.text for r in kept) == sorted(good)
    assert {r.text: r.doc_id for r in kept} == dict(zip(good, (None, 7, 7, 5, None, 7)))

    rows = [(i, t, "en", "s") for i in (None, 7) for t in (*marked, *good, None)]
    out = pipeline.personal_data(spark, spark.createDataFrame(rows, schema), "").collect()
    want = 2 * [*(f"{t} mail [EMAIL] or [IP]" for t in good), *good]
    assert sorted(r.text for r in out if r.text is not None) == sorted(want) and len(out) == len(rows)

    rows = [(i, t, "en", "s") for i in (None, 7) for t in good]
    lined = pipeline.lines(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted(r.text for r in lined) == sorted(2 * good)
    pieces = pipeline.pack(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sum(p.length for p in pieces) == 2 * sum(len(plain_ids(t)) for t in good)


def test_learned_identifiers_with_missing_and_repeated_ids(spark):
    rows = [(i % 2 or None, f"words here mail: user{i}@host.example.com and more") for i in range(20)]
    rows += [(None, "words mail: strange-7(at)host more"), (1, "clean words only, and more than enough of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(r.text for r in personal.redacted(docs).collect())
    assert out == sorted(20 * ["words here mail: [EMAIL] and more"] + ["words mail: [EMAIL] more", rows[-1][1]])


def test_run(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), "test")
    rows = docs.collect()
    assert 100 < len(rows) < 200
    assert not [r for r in rows if plain_spans(r.text)]
    assert all(r.n_chars == len(r.text) for r in rows)
    pieces = pipeline.run(spark, folder).collect()
    assert sum(p.length for p in pieces) == sum(len(plain_ids(r.text)) for r in rows)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}
