"""``op1`` to ``op13``: every operator with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import (
    byte_bpe, chat, exact_dedup, html_text, lexical, line_dedup, ngram_join, packing, passage_quality, personal, quality,
    spelling, substring_dedup,
)
from gaugeflow.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

# Word and line rules shared by the DuckDB texts.
_GAP = r"[\x20\x09-\x0D]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op1_ngram_jaccard_join")
def op1(docs: DataFrame) -> DataFrame:
    return ngram_join.near_duplicates(docs)


#: Longest sequence, and the id that ends a document.
CAPACITY, END_ID = 4096, 1


@query("op2_best_fit_packing")
def op2(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY)
    return packing.packed(pieces, CAPACITY)


@query("op3_byte_bpe")
def op3(docs: DataFrame) -> DataFrame:
    made = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_substring_dedup")
def op4(docs: DataFrame) -> DataFrame:
    return substring_dedup.removed_words(docs)


@query("op5_html_extraction", "pages")
def op5(pages: DataFrame) -> DataFrame:
    found = html_text.main_text(pages)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


_BUCKET = lambda v: f"({v}) // (1 << greatest(length(bin({v})) - 7, 0)) * (1 << greatest(length(bin({v})) - 7, 0))"


def _level(name: str, keys: str) -> str:
    """Fences of one level of groups, per metric."""
    k = f"{keys}, " if keys else ""
    return f"""{name}_u AS (SELECT {k}metric, bucket, sum(sum(n)) OVER (PARTITION BY {k}metric ORDER BY bucket) AS upto,
  sum(sum(n)) OVER (PARTITION BY {k}metric) AS total FROM sk GROUP BY {k}metric, bucket),
{name}_q AS (SELECT {k}metric, any_value(total) AS n, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1,
  min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3 FROM {name}_u GROUP BY {k}metric),
{name} AS (SELECT {k}metric, n, q1 - 3.0 * greatest(q3 - q1, least_gap) AS low, q3 + 3.0 * greatest(q3 - q1, least_gap) AS high
  FROM {name}_q JOIN gaps USING (metric))"""


_QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
c AS (SELECT doc_id, l, s, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_GAP}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, w,
  [{{'g': [w[i], w[i + 1], w[i + 2]], 'i': i}} for i in range(1, len(w) - 1)] AS g FROM w),
e AS (SELECT doc_id, unnest(g, recursive := true) FROM c),
rep AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + d)::BIGINT AS n FROM rep, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
b AS (SELECT doc_id, l, s, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words) AS base_failed,
  CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols,
  CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines
  FROM c LEFT JOIN cov USING (doc_id)),
m AS (UNPIVOT (SELECT l, s, word_length, symbols, dup_lines FROM b WHERE NOT base_failed)
  ON word_length, symbols, dup_lines INTO NAME metric VALUE v),
sk AS (SELECT l, s, metric, {_BUCKET("v")} AS bucket, count(*) AS n FROM m GROUP BY ALL),
gaps AS (SELECT * FROM (VALUES ('word_length', {quality.METRICS["word_length"]}), ('symbols', {quality.METRICS["symbols"]}),
  ('dup_lines', {quality.METRICS["dup_lines"]})) AS g(metric, least_gap)),
{_level("fs", "l, s")},
{_level("fl", "l")},
{_level("fa", "")},
f AS (SELECT fs.l, fs.s, fs.metric,
  CASE WHEN fs.n >= 30 THEN fs.low WHEN fl.n >= 30 THEN fl.low ELSE fa.low END AS low,
  CASE WHEN fs.n >= 30 THEN fs.high WHEN fl.n >= 30 THEN fl.high ELSE fa.high END AS high
  FROM fs JOIN fl USING (l, metric) JOIN fa USING (metric)),
p AS (SELECT l, s, max(low) FILTER (metric = 'word_length') AS wl, max(high) FILTER (metric = 'word_length') AS wh,
  max(low) FILTER (metric = 'symbols') AS sl, max(high) FILTER (metric = 'symbols') AS sh,
  max(low) FILTER (metric = 'dup_lines') AS dl, max(high) FILTER (metric = 'dup_lines') AS dh FROM f GROUP BY l, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_length BETWEEN wl - {quality.SAMPLING} / sqrt(greatest(n_words, 1))
    AND wh + {quality.SAMPLING} / sqrt(greatest(n_words, 1)) AND symbols BETWEEN sl AND sh
    AND dup_lines BETWEEN dl AND dh, false) AS kept
FROM b LEFT JOIN p USING (l, s)"""


@query("op6_quality_rules", sql=_QUALITY_SQL)
def op6(docs: DataFrame) -> DataFrame:
    return quality.judged(docs)


#: Schema of the one tool that plain conversations are read as.
REPLY_SCHEMA = [("reply", "prompt", "string", True), ("reply", "length", "integer", True)]


@query(
    "op7_chat_formatting",
    "conversations",
    """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT *, conv_id || '-' || turn AS id, conv_id || '-' || (turn - 2) AS after FROM c WHERE role = 'user'),
a AS (SELECT *, conv_id || '-' || (turn - 1) AS id FROM c WHERE role = 'assistant'),
r AS (SELECT u.*, EXISTS (SELECT 1 FROM u p WHERE p.id = u.after) AS has FROM u),
d AS (SELECT *, sum(CASE WHEN has THEN 0 ELSE 1 END) OVER w AS chain, row_number() OVER w AS rn
  FROM r WINDOW w AS (PARTITION BY conv_id, turn % 2 ORDER BY turn)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS depth FROM d)
SELECT e.conv_id, e.turn, 'call' AS kind, e.id, (2 * depth)::BIGINT AS depth,
  CASE WHEN a.id IS NULL THEN 'unanswered' ELSE 'answered' END AS status, 0::BIGINT AS n_errors,
  '{"after":' || to_json(e.after) || CASE WHEN a.id IS NULL THEN '' ELSE ',"answer":' || a.turn END ||
  ',"arguments":{"length":' || length(e.text) || ',"prompt":' || to_json(e.text) || '},"id":' || to_json(e.id) ||
  ',"name":"reply","type":"call"}' AS json
FROM e LEFT JOIN a USING (id)
UNION ALL
SELECT a.conv_id, a.turn, 'result', a.id, (2 * depth + 1)::BIGINT, CASE WHEN e.id IS NULL THEN 'orphan' ELSE 'linked' END, 0,
  '{"content":' || to_json(a.text) || ',"id":' || to_json(a.id) || ',"type":"result"}'
FROM a LEFT JOIN e USING (id)""",
)
def op7(conversations: DataFrame) -> DataFrame:
    """Calls and results only; turns of roles other than user and assistant give no rows."""
    spark = conversations.sparkSession
    schemas = spark.createDataFrame(REPLY_SCHEMA, "tool string, field string, type string, required boolean")
    events = chat.link_tool_calls(*chat.reply_calls(conversations), schemas)
    return events.select(
        "conv_id", "turn", "kind", "id", "depth", "status", F.size("errors").cast("long").alias("n_errors"), "json"
    )


@query(
    "op8_line_dedup",
    sql=f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT DISTINCT host, text, list_distinct([trim(x, {_TRIM}) for x in lines]) AS keys FROM d),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
l AS (SELECT host, unnest(keys) AS line FROM p),
b AS (SELECT host, list(line) AS drop_lines FROM (SELECT host, line, count(*) AS c FROM l WHERE line <> '' GROUP BY ALL)
  JOIN n USING (host) WHERE c >= 5 AND c > 0.05 * pages GROUP BY host),
k AS (SELECT doc_id, len(lines)::BIGINT AS n_lines,
  list_filter(lines, lambda x: NOT coalesce(list_contains(drop_lines, trim(x, {_TRIM})), false)) AS kept
  FROM d LEFT JOIN b USING (host))
SELECT doc_id, n_lines, n_lines - len(kept) AS n_removed, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM k""",
)
def op8(docs: DataFrame) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query("op9_personal_data")
def op9(docs: DataFrame) -> DataFrame:
    found = personal.personal_spans(docs)
    return found.select(
        "doc_id",
        *[personal.count_kind(F.col("base"), k).alias(f"n_{k}") for k in personal.KINDS],
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


@query(
    "op10_exact_dedup",
    sql="""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
  AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
)
def op10(docs: DataFrame) -> DataFrame:
    return exact_dedup.exact_duplicates(docs)


@query("op11_quality_classifier", also=("labels",))
def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return passage_quality.quality_scores(docs, labels)


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    "op12_ranked_lexical_search",
    also=("benchmark",),
    sql=f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM s),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM s)
  GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), g),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
  GROUP BY item_id, term),
r AS (SELECT item_id, doc_id, sum(times * w *
    ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // length))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20""",
)
def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return lexical.ranked_search(docs, benchmark)


@query("op13_spelling_variant_grouping")
def op13(docs: DataFrame) -> DataFrame:
    return spelling.spelling_variants(docs)
