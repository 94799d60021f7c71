"""Ids stay what they are: large ones, missing ones, and one id with several texts."""

import pytest

from gaugeflow.llm import ngram_join, queries, substring_dedup
from tests.llm.fixtures import prose

BIG = 2**60 + 1


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op9", "op13"])
def test_large_and_missing_ids(spark, name):
    rows = [(BIG, prose(1, 60)), (None, prose(2, 60)), (BIG, prose(3, 60)), (BIG + 2, "mail a.b@c.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = getattr(queries, name)(docs)
    if name == "op13":
        assert got.count() == 0
        return
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, BIG, BIG, BIG + 2]
    assert dict(got.dtypes)["doc_id"] == "bigint"


def test_one_id_with_two_texts_is_cut_by_its_own_text(spark, monkeypatch):
    passage = prose(5, 40)
    texts = [prose(6, 30) + " " + passage, prose(7, 30) + " " + passage, prose(8, 90)]
    for ids in ([7, 7, 7], [None, None, None], [1, 1, 2]):
        for group in (10_000, 1):
            monkeypatch.setattr(substring_dedup, "GROUP", group)
            docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
            got = substring_dedup.removed_words(docs).collect()
            assert sorted(r.n_removed for r in got) == [0, 0, 40]
            assert {r.n_words for r in got} == {70, 90}


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    a, c, big = prose(11, 120), prose(12, 120), 2**60 + 1
    words = a.split(" ")
    words[60] = "changed"
    b = " ".join(words)

    def result(rows):
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
        return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got), key=repr), got

    rows, got = result([(1, a), (1, c), (2, b), (3, c)])
    assert rows == [(1, 1, 0, 1), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 0, 1)]
    classes = {(r.doc_id, r.n_links): r.class_no for r in got}
    assert classes[1, 1] == classes[2, 1] != classes[1, 0] == classes[3, 0]
    assert result([(None, a), (big, b), (None, c)])[0] == [(big, big, 1, 0), (None, big, 1, 0), (None, None, 0, 0)]
    assert result([(None, a), (None, b)])[0] == [(None, None, 1, 0)] * 2


def test_one_of_each_keeps_a_users_columns(spark):
    text = prose(13, 50)
    docs = spark.createDataFrame([(1, text, 70), (2, text, 80), (3, "other words", 90)], "doc_id long, text string, __row long")
    kept = ngram_join.one_of_each(docs)
    assert sorted(map(tuple, kept.collect())) == [(1, text, 70), (3, "other words", 90)] and kept.columns == docs.columns
