"""Exact duplicates with frequent digests taken out of the shuffle (Misra-Gries split)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged, whole


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. For pure ASCII text that is what ``lower`` does, at less cost."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def exact_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = 0.001
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; missing text is empty text. Of equal
    texts the row with the largest id stays; among repeated rows of that id exactly one does
    (ids that are missing sort lowest). An empty table gives no rows. Other columns are ignored.

    1. Digests are computed once and staged.
    2. A Misra-Gries pass (``freqItems``) finds every digest held by more than ``support`` of the
       rows, at most ``1 / support`` of them. They are recounted exactly, with map-side
       combination, and their winners (that many rows at most) are broadcast: rows of frequent
       digests are settled where they lie and never shuffled.
    3. All other digests are grouped by an ordinary shuffle; no group there can hold more than
       ``support`` of the rows.
    """
    digest = F.sha2(lower_ascii(whole(text_col)), 256)
    rows = staged(
        docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest")),
        "digests",
    )
    me = F.struct("id", "row")
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = (
        rows.join(F.broadcast(frequent), "digest")
        .groupBy("digest")
        .agg(F.max(me).alias("best"), F.count("*").alias("size"))
    )
    settled = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(frequent), "digest", "left_anti").select(
        "digest", "id", "row", F.max(me).over(same).alias("best"), F.count("*").over(same).alias("size")
    )
    return settled.select(rest.columns).union(rest).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("best") == me).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, whole (ids must be unique within equal texts)."""
    kept = exact_duplicates(docs, text_col, id_col).filter("kept").select(F.col("doc_id").alias("__id"))
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
