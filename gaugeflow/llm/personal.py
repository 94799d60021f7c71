"""Personal data: four base patterns, and further identifiers by bootstrapped contexts."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import carried, restored, staged, text_key, unused, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words as contexts see them: an equals sign ends a word.
CONTEXT_RE = r"[^\x20\x09-\x0D=]*=|[^\x20\x09-\x0D=]+"
_CONTEXT = re.compile(CONTEXT_RE)
_MARK = re.compile("[0-9@]")
_EDGE = ".,;:!?()[]{}<>\"'"


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ with a domain back over the local part: linear, also for long runs of letters."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if not 16 <= len(digits) <= 19:
        return False
    doubled = (d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _is_phone(found: str) -> bool:
    return 8 <= sum(c.isdigit() for c in found) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds in the order of ``KINDS``, then by start; a match that fails its test is dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for kind, pattern, test in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if test(m[0])]
    return out


def _left(text: str, start: int) -> str:
    """The word before a place, lower-cased; empty at the start of a text."""
    words = _CONTEXT.findall(text[max(0, start - 80) : start])
    return words[-1].lower() if words else ""


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """``(kind, instance, left, start, end)`` of the spans, and of words that look like identifiers.

    Those hold a digit or an @, have four characters at least besides punctuation at their ends,
    and do not touch a span; their kind is null.
    """
    out = [(kind, text[a:b].lower(), _left(text, a), a, b) for kind, a, b in spans]
    if not _MARK.search(text):
        return out
    taken = sorted((a, b) for _, a, b in spans)
    i = 0
    for m in _CONTEXT.finditer(text):
        word = m[0]
        if not _MARK.search(word):
            continue
        a = m.start() + len(word) - len(word.lstrip(_EDGE))
        b = m.end() - (len(word) - len(word.rstrip(_EDGE)))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a >= 4 and not (i < len(taken) and taken[i][0] < b):
            out.append((None, text[a:b].lower(), _left(text, a), a, b))
    return out


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, key, base, found`` per row: a digest of the text, base spans as ``kind:start:end`` joined by commas, and occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                spans = base_spans(text)
                rows.append((doc, key, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), occurrences(text, spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "base", "found"])

    texts = docs.select(carried(id_col), text_key(text_col).alias("key"), whole(text_col).alias("text"))
    made = texts.mapInPandas(
        run,
        "doc_id string, key string, base string, "
        "found array<struct<kind:string,instance:string,left:string,start:int,end:int>>",
    )
    return restored(made, docs, id_col)


def learned_instances(
    occurred: DataFrame, texts: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.7
) -> DataFrame:
    """``instance, kind, score`` of identifiers that reliable contexts give away.

    ``occurred`` has one row per occurrence, ``texts`` a column ``text`` with all texts. A pattern
    is a kind and the word on the left. Its confidence is the share of that word's occurrences,
    counted over all texts, that stand before an instance of the kind, each weighted by the
    instance's score; it also needs ``support`` different instances. Seeds score 1. An instance of
    unknown kind scores the probability that one of its reliable patterns is right. Scores flow
    between patterns and instances for ``rounds`` rounds, or until nothing new is reliable. The
    graph has one edge per pattern and instance, combined map-side; only scores of edges near seeds
    or reliable patterns are ever joined.
    """
    edges = staged(
        occurred.filter("left <> ''").groupBy("left", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind")),
        "personal-edges",
    )
    seeds = edges.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    rich = staged(
        edges.groupBy("left").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("left"),
        "personal-rich",
    )
    # one row per word and task is shuffled, not one per occurrence
    words = F.regexp_extract_all(F.lower("text"), F.lit(CONTEXT_RE), F.lit(0))
    counted = texts.select(F.explode(words).alias("left")).groupBy("left").agg(F.count("*").alias("total"))
    totals = staged(counted.join(rich, "left"), "personal-contexts")
    edges = edges.select("left", "instance", "n").join(totals, "left")
    scores, before = seeds, 0
    for _ in range(rounds):
        patterns = (
            edges.join(scores, "instance")
            .groupBy("kind", "left")
            .agg(F.sum("score").alias("support"), F.sum(F.col("n") * F.col("score") / F.col("total")).alias("confidence"))
            .filter((F.col("support") >= support) & (F.col("confidence") >= confidence))
        )
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        found = (
            edges.join(patterns, "left")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(doubt)).alias("score"))
            .join(seeds.select("instance"), "instance", "left_anti")
        )
        found = staged(found, "personal-learned")
        n = found.count()
        if n == before:
            break
        scores, before = seeds.unionByName(found), n
    return scores.filter("score < 1")


def personal_spans(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    rounds: int = 3,
    support: int = 3,
    confidence: float = 0.7,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, spans`` as ``kind:start:end`` joined by commas.

    ``base`` holds the base kinds; ``spans`` the same, then ``like_<kind>`` for identifiers found by
    context (see ``learned_instances``), by kind and start. Places count code points, the end is
    exclusive. Missing text is empty and has no spans. Spans follow the text alone: ids may be missing
    or repeat. An empty table gives no rows.
    """
    return _spans(docs, text_col, id_col, rounds, support, confidence).drop("key")


def _spans(
    docs: DataFrame, text_col: str, id_col: str, rounds: int = 3, support: int = 3, confidence: float = 0.7
) -> DataFrame:
    """``doc_id, key, base, spans``; what contexts give away is joined on the digest of the text."""
    scanned, added = _scanned(docs, text_col, id_col, rounds, support, confidence)
    joined = scanned.select("doc_id", "key", "base").join(added, "key", "left")
    both = F.array(F.when(F.col("base") != "", F.col("base")), F.col("added"))
    return joined.select("doc_id", "key", "base", F.array_join(F.array_compact(both), ",").alias("spans"))


def _scanned(
    docs: DataFrame, text_col: str, id_col: str, rounds: int = 3, support: int = 3, confidence: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """The staged scan, and ``key, added``: what contexts give away, of texts that hold any."""
    scanned = staged(scan(docs, text_col, id_col), "personal-scan")
    occurred = scanned.select("key", F.explode("found").alias("o")).select("key", "o.*")
    texts = docs.select(whole(text_col).alias("text"))
    learned = learned_instances(occurred, texts, rounds, support, confidence)
    best = learned.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind")
    extra = (
        occurred.filter("kind IS NULL").drop("kind").join(best, "instance").select("key", "kind", "start", "end").distinct()
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))
    )
    text = lambda s: F.concat(F.lit("like_"), s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])
    return scanned, extra.select("key", F.array_join(F.transform("extra", text), ",").alias("added"))


def count_kind(spans: Column, kind: str) -> Column:
    """How many spans of a kind a span text holds."""
    return F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(f"{kind}:"))).cast("long")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of spans that touch one another the first names all."""
    if not spans:
        return text
    out, at = [], 0
    marks = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    for a, b, kind in marks:
        if a >= at:
            out += [text[at:a], f"[{kind.removeprefix('like_').upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with personal data in the text replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``.

    No row is dropped and missing text stays missing. Base spans follow from the row itself; only what
    contexts give away is joined, on the digest of the text: ids may be missing or repeat. That
    table holds few texts and is staged, so that Spark sees its size and texts stay where they lie.
    """
    _, added = _scanned(docs, text_col, id_col, **options)
    key, more = unused("__key", docs), unused("__added", docs)
    added = staged(added.toDF(key, more), "personal-added")

    @F.pandas_udf("string")
    def replace(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, extra in zip(text, found):
            if t is not None:
                base = [f"{k}:{a}:{b}" for k, a, b in base_spans(t)]
                t = redact(t, ",".join([*base, extra] if extra else base))
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = docs.join(added, text_key(text_col) == F.col(key), "left")
    # every base kind needs an @ or a digit: other texts need not go through Python
    may_hold = F.coalesce(docs[text_col].rlike("[@0-9]"), F.lit(False)) | F.col(more).isNotNull()
    changed = [replace(docs[c], F.col(more)).alias(c) if c == text_col else docs[c] for c in docs.columns]
    return joined.filter(may_hold).select(*changed).union(joined.filter(~may_hold).select(*[docs[c] for c in docs.columns]))
