"""Ranked lexical search against a plain reading of the contract."""

import math
import random
import re
from collections import Counter

import pytest

from gaugeflow.llm import lexical, queries
from tests.llm.fixtures import odd_documents, odd_texts, prose, without_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * N) // L
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical, "FIRST_READ", 1)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    texts += [texts[k % 30] for k in range(60)]  # copies: ties across shards
    docs = [(None if k % 70 == 3 else 2**60 + 7 * (k * 7919 % 1009), t) for k, t in enumerate(texts)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(40)]
    return docs, [*items, (None, items[0][1]), (3, items[5][1]), (50, "absent"), (51, None), (52, "w1 " * 9), (53, docs[4][1])]


def test_against_brute_force(spark):
    docs, items = corpus()
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute(docs, items)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_small_shards_steps_and_blocks_give_the_same(spark, small_steps, monkeypatch):
    docs, items = corpus(2, 120)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.ranked_search(frame, asked, top=5)) == brute(docs, items, 5)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 250)
    assert rows_of(lexical.ranked_search(frame, asked)) == brute(docs, items)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = [(1, prose(2, 400)), (2, "#$%"), (3, "中文 É x Z"), (4, prose(1, 30_000)), (5, "the ABC a b c")]
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    assert rows_of(queries.op12(docs, asked)) == brute(odd_texts(), items)
    none = asked.filter("false")
    assert queries.op12(docs, none).count() == 0
    assert queries.op12(without_rows(spark), asked).count() == 0
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert queries.op12(blank, asked).count() == 0


def test_reading_stops_before_the_lists_end(spark, monkeypatch):
    read = []
    find = lexical.Lists.best

    class Counted:
        def __init__(self, data):
            self.data = data

        def __getitem__(self, key):
            read.append(1 if not isinstance(key, slice) else len(self.data[key]))
            return self.data[key]

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 20_000
    one = np.ones(n, dtype="<i4")
    tf = np.minimum(rng.pareto(0.5, n) + 1, 10**6).astype("<i4")
    shard = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([100] * n), pa.array([b"\0\0\0\0"] * n), pa.array([x.tobytes() for x in tf])],
        names=["doc_id", "n", "terms", "counts"],
    )
    lists = lexical.Lists(shard, np.array([5]), n, 100 * n)
    lists.doc = Counted(lists.doc)
    places, scores = find(lists, np.array([0]), one[:1].astype(int), 20, 0)
    assert len(places) >= 20 and sum(read) < n / 10
    assert sorted(scores.tolist())[-20:] == sorted(lists.impact.tolist())[-20:]


def test_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(queries.QUERIES["op12_ranked_lexical_search"](spark, folder)) == brute(docs, items)
