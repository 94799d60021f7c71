"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import GAP, staged, whole


def _line_key(line: Column) -> Column:
    """128 bits that stand for a line without its outer white space; null for a blank line."""
    trimmed = F.btrim(line, F.lit(GAP))
    return F.when(trimmed != "", F.md5(trimmed))


def _host(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.05, min_pages: int = 5
) -> DataFrame:
    """``host, keys``: lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least.

    Identical pages of a host are one page. Counts cover every page; they are combined map-side
    before the shuffle on (host, line), so a hot host, line or group of copies arrives as one row
    per task. A host keeps fewer than (mean lines per page / ``ratio``) keys, however many pages
    it has.
    """
    text = whole(text_col)
    keys = F.array_compact(F.array_distinct(F.transform(_lines(text), _line_key)))
    pages = docs.select(_host(host).alias("host"), F.md5(text).alias("page"), keys.alias("keys")).dropDuplicates(
        ["host", "page"]
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    return (
        lines.filter(F.col("n") >= min_pages)
        .join(totals, "host")
        .filter(F.col("n") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("key").alias("keys"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: Column | None = None,
    text_col: str = "text",
    ratio: float = 0.05,
    min_pages: int = 5,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus ``__n_lines`` and ``__n_removed``.

    A line is dropped, wherever it stands on the page, when more than ``ratio`` of its host's
    pages hold it. Lines are compared without their outer white space; blank lines always stay.
    Missing text stays missing, missing hosts count as one host, repeated rows as one page. A text of
    boilerplate only becomes empty; no row is dropped.

    The table of frequent lines is staged first, so Spark knows its size when it plans the join:
    it is broadcast below the session's threshold, and else joined on the host, where adaptive
    execution splits hot hosts.
    """
    host = F.col("source") if host is None else host
    frequent = staged(boilerplate(docs, host, text_col, ratio, min_pages), "boilerplate")
    frequent = frequent.select(F.col("host").alias("__host"), F.col("keys").alias("__keys"))
    joined = docs.withColumn("__host", _host(host)).join(frequent, "__host", "left")
    none = F.array().cast("array<string>")
    split = joined.withColumns({"__lines": _lines(whole(text_col)), "__keys": F.coalesce("__keys", none)})
    kept = split.withColumn(
        "__kept",
        F.when(F.size("__keys") == 0, F.col("__lines")).otherwise(
            F.filter(
                "__lines", lambda x: ~F.coalesce(F.array_contains(F.col("__keys"), _line_key(x)), F.lit(False))
            )
        ),
    )
    rewritten = F.when(F.col(text_col).isNotNull(), F.array_join("__kept", "\n"))
    return kept.select(
        *[rewritten.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("__n_removed"),
    )
