"""Every operator against a plain reading of its contract, on odd rows and on no rows."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from gaugeflow.llm import (
    byte_bpe, chat, exact_dedup, html_text, line_dedup, ngram_join, packing, personal, quality, queries, substring_dedup,
)
from tests.llm.fixtures import odd_documents, odd_texts, prose, without_rows

WORDS = re.compile("[^\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


DOCUMENT_QUERIES = ["op1", "op2", "op3", "op4", "op6", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_no_rows(spark, name):
    assert getattr(queries, name)(without_rows(spark)).count() == 0


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_null_id_and_every_column_null(spark, name):
    rows = spark.createDataFrame([(None,) * 12, (1, "some text") + (None,) * 10], without_rows(spark).schema)
    assert getattr(queries, name)(rows).count() == 2


# --- exact duplicates


def test_exact_duplicates(odd):
    got = exact_dedup.exact_duplicates(odd).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in odd_texts():
        groups[lower(t)].append(i)
    want = {}
    for t, ids in groups.items():
        for i in ids:
            want[i] = (max(ids), len(ids), sha(t))
    assert len(got) == len(odd_texts())
    assert all((r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id] for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha(t) for t in groups)  # one stays, also of repeated rows


def test_exact_duplicates_with_a_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Copy' ELSE concat('t', id) END AS text")
    got = exact_dedup.exact_duplicates(docs, support=0.01)
    assert got.filter("kept").count() == 2001
    assert got.filter("group_size = 1000 AND keep_id = 2997").count() == 1000
    assert exact_dedup.deduplicated(docs).count() == 2001


# --- byte-level BPE


def test_byte_bpe(odd):
    import tiktoken

    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = byte_bpe.load_encoding(file, pattern)
    assert isinstance(enc, tiktoken.Encoding)
    got = [(r.doc_id, r.ids, r.decoded) for r in byte_bpe.round_trip(odd, file, pattern).collect()]
    assert len(got) == len(odd_texts())
    texts = dict(odd_texts())
    for i, ids, decoded in got:
        text = texts[i] or ""
        assert bytes(decoded) == text.encode()
        if len(text) < 10_000:
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)


def test_byte_bpe_cuts_long_texts_safely():
    enc = byte_bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = prose(9, 3_000) + "\n\n  x   y  z\x1c w" + prose(10, 50)
    parts = list(byte_bpe.safe_parts(text, 37))
    assert "".join(parts) == text and len(parts) > 100
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    spaced = "a" + " " * 300 + "b"
    whole = byte_bpe.LONG_RUN
    byte_bpe.LONG_RUN = 50
    try:
        assert byte_bpe.encode_text(enc, spaced).tolist() == enc.encode_ordinary(spaced)
    finally:
        byte_bpe.LONG_RUN = whole


def test_byte_bpe_columns(spark):
    from pyspark.sql import functions as F

    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, "naïve 中"), (2, None)], "doc_id long, text string")
    df = df.withColumn("p", byte_bpe.encode(F.col("text"), file, pattern))
    df = df.select("text", byte_bpe.token_ids(F.col("p")).alias("ids"), byte_bpe.decode(F.col("p"), file, pattern).alias("b"))
    for r in df.collect():
        assert bytes(r.b).decode() == (r.text or "") and bool(r.ids) == bool(r.text)


# --- line dedup


def test_line_dedup(spark):
    rows = [(i, f"menu \nbody {i}\n\n menu\nrare" if i < 6 else f"body {i}\nmenu x", "a") for i in range(8)]
    rows += [(20, "menu\nalone", "b"), (21, None, "b"), (22, "", None), (23, "menu", None)]
    rows += [(30 + i, "copy\nof a page", "c") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r["__n_lines"], r["__n_removed"]) for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0] == ("body 0\n", 5, 3)
    assert got[7] == ("body 7\nmenu x", 2, 0)
    assert got[20] == ("menu\nalone", 2, 0) and got[21] == (None, 1, 0) and got[22][0] == ""
    assert got[30] == ("copy\nof a page", 2, 0)  # equal pages are one page


def test_line_dedup_keeps_rows_and_columns(odd):
    got = line_dedup.drop_boilerplate(odd)
    assert got.columns == [*odd.columns, "__n_lines", "__n_removed"]
    assert got.count() == odd.count()


# --- quality


def plain_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_quality_counts(odd):
    texts = dict(odd_texts())
    for r in quality.judged(odd).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_counts(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_thresholds_follow_the_group(spark):
    rows = [(i, prose(i, 200), "en", "s") for i in range(60)]
    rows += [(100 + i, "".join(w + "%%%% " for w in prose(i, 200).split()), "en", "s") for i in range(5)]
    rows += [(200 + i, "".join(w + "%%%% " for w in prose(i, 200).split()), "xx", "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert set(range(60)) <= kept and not kept & set(range(100, 105))
    assert set(range(200, 260)) <= kept  # usual where it comes from


# --- chat

SCHEMAS = [("find", "q", "string", True), ("find", "n", "integer", False), ("find", "x", "number", False)]


def chat_rows(spark, calls, results):
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    calls = spark.createDataFrame(calls, "conv_id long, turn long, id string, name string, arguments string, after string")
    results = spark.createDataFrame(results, "conv_id long, turn long, id string, content string")
    return {(r.conv_id, r.kind, r.turn, r.id): r for r in chat.link_tool_calls(calls, results, schemas).collect()}


def test_chat_links_orders_and_validates(spark):
    calls = [
        (1, 1, "a", "find", '{"q": "é/\\"", "n": 2}', None), (1, 3, "b", "find", '{"n": "2", "z": 1}', "a"),
        (1, 5, "c", "find", "[1]", "b"), (1, 7, "d", "lost", "{}", "none"), (1, 9, "a", "find", '{"q": "later"}', None),
        (2, 1, "a", "find", "not json", "b"), (2, 2, "b", "find", '{"q": "x", "x": 1}', "a"), (2, 3, "e", "find", None, None),
        (3, 1, None, None, None, None), (None, None, "a", "find", '{"q": null}', None),
    ]
    results = [(1, 2, "a", "r"), (1, 4, "b", None), (1, 8, "a", "again"), (4, 1, "a", "nobody"), (None, 1, None, None)]
    got = chat_rows(spark, calls, results)
    assert len(got) == len(calls) + len(results)
    call = lambda c, t, i: got[c, "call", t, i]
    assert (call(1, 1, "a").status, call(1, 1, "a").depth, call(1, 1, "a").errors) == ("answered", 0, [])
    assert call(1, 1, "a").json == '{"answer":2,"arguments":{"n":2,"q":"é/\\""},"id":"a","name":"find","type":"call"}'
    assert call(1, 3, "b").depth == 2 and call(1, 5, "c").depth == 4 and call(1, 7, "d").depth == 0
    assert call(1, 3, "b").errors == ["missing field q", "unknown field z", "wrong type of n"]
    assert call(1, 5, "c").errors == ["arguments are not an object"] and call(1, 7, "d").errors == ["unknown tool"]
    assert call(1, 9, "a").status == "duplicate" and call(1, 5, "c").status == "unanswered"
    assert call(2, 1, "a").status == call(2, 2, "b").status == "cycle" and call(2, 1, "a").depth is None
    assert call(2, 2, "b").errors == [] and json.loads(call(2, 1, "a").json)["arguments"] == "not json"
    assert got[1, "result", 2, "a"].depth == 1 and got[1, "result", 2, "a"].status == "linked"
    assert got[1, "result", 8, "a"].status == "duplicate" and got[4, "result", 1, "a"].status == "orphan"


def test_chat_long_chain(spark):
    calls = [(1, i, f"c{i}", "find", '{"q":"x"}', f"c{i - 1}" if i else None) for i in range(100)]
    got = chat_rows(spark, calls, [])
    assert [got[1, "call", i, f"c{i}"].depth for i in range(100)] == [2 * i for i in range(100)]


def test_chat_messages(spark):
    text = json.dumps({"tool_calls": [{"id": "a", "name": "find", "arguments": {"q": 1}}, {"id": "b", "name": "find"}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "tool", '{"tool_call_id":"a","content":"r"}'),
            (1, 3, "assistant", "plain"), (1, 4, "tool", "plain"), (None, None, None, None)]
    calls, results = chat.tool_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.id, r.arguments) for r in calls.orderBy("id").collect()] == [("a", '{"q":1}'), ("b", None)]
    assert [tuple(r) for r in results.collect()] == [(1, 2, "a", "r")]


def test_chat_no_rows(spark):
    assert chat_rows(spark, [], []) == {}


# --- packing


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing(odd):
    rows = queries.op2(odd).collect()
    want = Counter()
    for i, t in odd_texts():
        ids = plain_ids(t)
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 4096)


def check_places(rows, capacity):
    by = defaultdict(list)
    for s, offset, length in rows:
        by[s].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("low, high", [(1, 4096), (1, 900), (1300, 2200), (700, 2500), (2049, 2100)])
def test_plan_places_every_rank(low, high):
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in Counter(rng.integers(low, high + 1, 5_000).tolist()).items()}
    plan = packing.make_plan(counts, 4096)
    rows, ranks = [], defaultdict(list)
    after = defaultdict(list)
    for row in sorted(plan.rows):
        after[row[0]].append(row)
    for length, parts in after.items():
        ends = [p[1] for p in parts[1:]] + [counts[length]]
        for (_, rank, first, offset), end in zip(parts, ends):
            rows += [(first + k, offset, length) for k in range(end - rank)]
            ranks[length] += range(rank, end)
    assert all(ranks[x] == list(range(n)) for x, n in counts.items())
    n = check_places(rows, 4096)
    plain = packing.Plan(counts, 4096)
    plain.best_fit()
    assert n == plan.n_sequences <= 1.01 * plain.n_sequences + 1


def test_price_is_an_exact_knapsack():
    sizes, weights = np.array([3, 5, 7]), np.array([3.1, 5.3, 7.2])
    best = max(
        (a * 3.1 + b * 5.3 + c * 7.2 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    )
    assert abs(packing.price(weights, sizes, 23) @ weights - best) < 1e-9


# --- substring dedup


def test_deep_nodes_share_a_window():
    group = [(2, 20, 5, "a b c d"), (1, 10, 0, "b c d e"), (1, 10, 9, "a b c"), (1, 10, 9, "a b c")]
    nodes = list(substring_dedup.deep_nodes(group, 3))
    assert nodes == [[(1, 10, 9), (1, 10, 9), (2, 20, 5)], [(1, 10, 0), (2, 20, 6)], [(1, 10, 1)]]
    assert substring_dedup.later_places(group, 3) == [(20, 5, 6)]
    assert substring_dedup.first_places(group, 3) == [(10, 0, 1), (10, 9, 9)]


@pytest.mark.parametrize("group, frequent, folded", [(1, 1_000, 100_000), (1, 2, 1), (3, 0, 10), (40, 1, 5), (10_000, 1_000, 100_000)])
def test_substring_dedup(odd, group, frequent, folded, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(substring_dedup, "FOLDED", folded)
    want, first = Counter(), set()
    seen_rows = set()
    for i, t in sorted(odd_texts(), key=lambda r: r[0]):
        w = WORDS.findall(t or "")
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in first:
                gone |= set(range(k, k + 20))
            first.add(window)
        seen_rows.add(i)
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[i, len(w), len(gone), sha(" ".join(kept))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed_words(odd).collect())
    assert got == want


def test_substring_dedup_leaves_anchors_where_they_are(spark, monkeypatch):
    """Only the few copies are sent to the scanned texts, not the list of all first texts."""
    plans, write = {}, substring_dedup.staged

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(substring_dedup, "staged", recorded)
    texts = [" ".join(f"w{i}-{k}" for k in range(25)) for i in range(4_000)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:3])), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        got = {r.doc_id: r.n_removed for r in substring_dedup.removed_words(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {i for i, n in got.items() if n} == {4_000, 4_001, 4_002} and len(got) == 4_003
    assert "BroadcastHashJoin" in plans["substring-anchors"] and "SortMergeJoin" not in plans["substring-anchors"]


# --- n-gram join


def plain_near(texts):
    grams = {}
    for i, t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        grams[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return grams


def test_ngram_join(spark):
    base = prose(20, 120).split(" ")
    texts = [(i, t) for i, t in odd_texts() if i != 23]
    for k in range(40):  # a group of near copies, not all alike
        copy = [*base]
        for j in range(k % 4):
            copy[(7 * k + 31 * j) % 120] = f"edit{k}"
        texts.append((100 + k, " ".join(copy)))
    grams = plain_near(texts)
    sets = defaultdict(list)
    for i, g in sorted(grams.items()):
        if g:
            sets[g].append(i)
    reps = {v[0]: g for g, v in sets.items()}
    links, up = Counter(), {r: r for r in reps}
    root = lambda x: x if up[x] == x else root(up[x])
    for a in reps:
        for b in reps:
            if a < b and len(reps[a] & reps[b]) >= 0.8 * len(reps[a] | reps[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    want = {i: (i, 0, 0) for i, _ in texts}
    for g, ids in sets.items():
        for i in ids:
            want[i] = (root(ids[0]), links[ids[0]], len(ids) - 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == want and max(links.values()) > 5
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {i for i in want if want[i][0] == i}


def test_ngram_join_tiles(spark, monkeypatch):
    base = prose(21, 100).split(" ")
    texts = [(k, " ".join([*base[: k % 90], f"w{k}", *base[k % 90 + 1 :]])) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    monkeypatch.setattr(ngram_join, "GRAM_TILE", 900)
    monkeypatch.setattr(ngram_join, "BUCKET_TILE", 7)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == whole


def test_ngram_join_of_short_texts(spark):
    texts = [(1, "three short words"), (2, "Three short, words!"), (3, "three short"), (4, "short three words"), (5, "one"),
             (6, "one"), (7, "one"), (8, "three short words and two more"), (9, ""), (10, None), (11, "..."), (12, "a b c d")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.near_duplicates(docs).collect()}
    want = {i: (i, 0, 0) for i, _ in texts} | {1: (1, 0, 1), 2: (1, 0, 1)} | {i: (5, 0, 2) for i in (5, 6, 7)}
    assert got == want
    assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} == {1, 3, 4, 5, 8, 9, 10, 11, 12}


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.bands_for(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128


# --- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(d[0::2] + [x * 2 - 9 if x > 4 else x * 2 for x in d[1::2]]) % 10 == 0


def plain_spans(text):
    tests = {"email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
             "card": (CARD, luhn), "phone": (PHONE, lambda s: 8 <= sum(c.isdigit() for c in s) <= 15)}
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m[0])]


ODD_PERSONAL = [
    "", "@", "a@b", "a@b.c", "x@y.z@q.r", "..@a.b.c.", "é@a.b a@é.b", "a@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 0001.2.3.4",
    "4111111111111111", "4111-1111-1111-1111 2", "+1 2", "+12345678", "+1--5 (555) 1234567)", "++1234567890", "+1(2)3.4-5 6789 x",
    "a@b.c,d@e.f", "a@b.c.d@e.f", "9" * 5000 + ".1.2.3", "name+tag%x@host-1.example.org.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_base_spans_of_personal_data():
    for text in [*ODD_PERSONAL, *(t or "" for _, t in odd_texts() if len(t or "") < 10_000)]:
        if len(text) < 4000:
            assert personal.base_spans(text) == plain_spans(text), text[:80]
        else:
            personal.base_spans(text)


def test_personal_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"words here mail: user{i}@host.example.com and more") for i in range(20)]
    rows += [(50, "words mail: strange-7(at)host more"), (51, "nothing 12345678 here"), (52, None), (53, "the 77777 the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal.personal_spans(docs).collect()}
    assert got[3].spans == got[3].base == "email:17:39"
    assert got[50].base == "" and got[50].spans == "like_email:12:29"
    assert got[51].spans == got[52].spans == got[53].spans == ""
    clean = {r.doc_id: r.text for r in personal.redacted(docs).collect()}
    assert clean[3] == "words here mail: [EMAIL] and more" and clean[50] == "words mail: [EMAIL] more" and clean[52] is None


def test_redacted_keeps_rows_and_columns(odd):
    got = personal.redacted(odd)
    assert got.columns == odd.columns and got.count() == odd.count()


# --- pages


def test_html_blocks():
    page = """<html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><header><h1>site</h1></header>
    <nav>menu</nav><article class="post"><header><h1>Head &amp; line</h1></header><p>one <b>two<br>three<p>four&nbsp;&eacute;
    <ul><li>a<li>b</ul><div class="ad-box"><p>buy</p></div><form>f</form><script>x("</p>")</script><!-- c --><aside>no</aside>
    <div id="comments"><article><p>reader</p></article></div>tail</article><footer>foot</footer></body></html>"""
    got = [t for _, t in html_text.main_blocks(html_text.parse(page))]
    assert got == ["Head & line", "one two three", "four é", "a", "b", "tail"]
    for odd in ("", "plain", "<", "<p", "<article", "</p></p>", "<p>a<", "a<!-- b", "&#x110000; &bogus; &am", "<" * 50, "<div>" * 3000 + "x"):
        html_text.parse(odd)
    assert [t for _, t in html_text.main_blocks(html_text.parse("<p>a</p><p>b <a"))] == ["a", "b"]


def test_html_names_of_wrappers_and_blocks():
    blocks = lambda page: [t for _, t in html_text.main_blocks(html_text.parse(page))]
    article = "<article><h1>Head</h1><p>text</article>"
    for name in ("layout no-sidebar", "page has-header", "with-side", "sidebar", "search", "header widget"):
        assert blocks(f"<body><div class='{name}'>{article}</div><p>out</p></body>") == ["Head", "text"], name
        assert blocks(f"<main><div class='{name}'>{article}</div></main>") == ["Head", "text"], name
        assert blocks(f"<div id='{name}'><main><p>text</p></main></div>") == ["text"], name
    for name in ("entry-header", "side-by-side", "search-results", "widget", "header"):
        assert blocks(f"<article><div class='{name}'><h1>Head</h1><p>in</p></div><p>text</article>") == ["Head", "in", "text"], name
    for name in ("ad", "ad-box", "comments", "share-buttons", "related-posts", "site-footer"):
        assert blocks(f"<article><p>text</p><div class='x {name}'>no</div></article>") == ["text"], name
    assert blocks("<article><h1 class='share'>Head</h1>text</article>") == ["Head", "text"]
    assert blocks(f"<div class='related'><article>teaser</article></div>{article}") == ["Head", "text"]
    assert blocks("<main><p>text</p><div class='related'><article>a</article><article>b</article></div></main>") == ["text"]
    assert blocks(f"<form>{article}</form><p>out") == ["out"]


def test_simple_tree_matching():
    a = ["", 0, [["nav", 1, []], ["div", 2, [["p", 3, []]]], ["footer", 4, []]]]
    b = ["", 0, [["div", 1, [["h1", 2, []], ["p", 3, []]]], ["aside", 4, []], ["footer", 5, []]]]
    n, pairs = html_text.match(a, b)
    assert n == 4 and set(pairs) == {(0, 0), (2, 1), (3, 3), (4, 5)}


def test_html_template_lines_go(spark):
    page = lambda i: (
        f"<body><nav>n{i}</nav><article><p>Read us daily</p><p>story {i}</p>{'<div>x</div>' if i % 2 else ''}</article></body>"
    )
    rows = [(i, f"https://u@Www.Host.example:80/p/{i}", page(i)) for i in range(20)]
    rows += [(90, "http://other.example/", page(1)), (91, None, None), (92, "odd", "<p>x")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "story 2" and got[3].startswith("story 3") and got[90] == "Read us daily\nstory 1\nx"
    assert got[91] == "" and got[92] == "x"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string, tree int")).count() == 0


def test_html_templates_of_mixed_and_small_hosts(spark):
    frames = [
        "<body><div class='a'><article><p>Read us</p><p>story {i}</p></article></div></body>",
        "<body><div class='b'><nav>n</nav><article><p>story {i}</p><p>Write us</p></article></div></body>",
        "<body><section><article><h1>Head {i}</h1>{x}<p>Call us</p><p>story {i}</p></article></section></body>",
    ]
    page = lambda i: frames[i % 3].format(i=i, x="<div class='odd'><p>x</p></div>" * (i % 2))
    rows = [(i, "http://mixed.example/", page(i)) for i in range(36)]
    rows += [(100 + i, "http://small.example/", page(3 * i)) for i in range(3)]
    rows += [(300 + k, "http://odd.example/", f"<body><div class='q{c}'>z</div><article><p>Join us</p><p>story {k}</p></article>")
             for k, c in enumerate("abcdef")]
    rows += [(200, "http://single.example/", page(0)), (201, "http://mixed.example/", ""), (202, None, page(0))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(docs).collect()}
    want = lambda i: f"story {i}" if i % 3 < 2 else f"Head {i}\nstory {i}"
    assert {i: got[i] for i in range(36)} == {i: want(i) for i in range(36)}  # x stands on half of its template's pages
    assert [got[100 + i] for i in range(3)] == [f"story {3 * i}" for i in range(3)]
    assert [got[300 + k] for k in range(6)] == [f"story {k}" for k in range(6)]  # no two of one template
    assert got[200] == got[202] == "Read us\nstory 0" and got[201] == ""


def test_slots_without_match_stand_by_their_path():
    one, two = (html_text.tree_of(html_text.parse(p).root) for p in ("<div><p>a</div><ul><li>b</ul>", "<ul><li>b</ul>"))
    assert set(html_text.paths(two).values()) < set(html_text.paths(one).values())
