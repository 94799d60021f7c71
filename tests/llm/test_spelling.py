"""Spelling variants against a plain reading of the contract."""

import random
import re
import zlib
from collections import Counter

import pytest

from gaugeflow.llm import queries, spelling
from tests.llm.fixtures import odd_documents, odd_texts, without_rows

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, None, n, len(near), words[form] if form else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def collected(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def typo_rows(seed=1, n=1500):
    rng = random.Random(seed)
    letters = "abcdéÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((None if i % 50 == 3 else 2**60 + i, rng.choice([" ", ", ", "-", "œ", "1"]).join(words)))
    return rows + rows[:20]


def test_against_brute_force(spark):
    rows = typo_rows()
    want = brute_forms(brute_words(rows))
    assert len(want) > 800 and sum(v[0] is not None for v in want.values()) > 300
    assert any(v[1] != v[0] for w, v in want.items() if v[0])  # chains of more than one form
    got = collected(queries.op13(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == want


def test_bounded_passes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PASS_BYTES", 1024)
    monkeypatch.setattr(spelling, "PROBES", 500)
    rows = typo_rows(2, 60)
    assert len(spelling._passes({6: 500, 7: 2000})) > 3
    got = collected(queries.op13(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_forms(brute_words(rows))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = collected(queries.op13(docs))
    assert got == brute_forms(brute_words(odd_texts()))
    long = "ab" * 30_000
    rows = [(i, w) for i, w in enumerate([long] * 5 + [long + "c"] * 25 + ["MULTIPLY×÷ multiply"] * 3 + [None, ""])]
    got = collected(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), typo_every=0))
    assert got[long] == (long + "c", long + "c", 5, 1, 25) and len(got) == 2
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert queries.op13(nulls).count() == 0
    assert queries.op13(without_rows(spark)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_given_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = brute_words([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = collected(queries.QUERIES["op13_spelling_variant_grouping"](spark, folder))
    assert {w: v[2] for w, v in got.items()} == words
    some = random.Random(3).sample(sorted(words), 150)
    for w in some:
        near = [x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        assert got[w][3] == len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        assert got[w][0] == (best if best and words[best] >= 5 * words[w] else None)
