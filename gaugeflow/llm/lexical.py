"""Ranked lexical search without random access (NRA): impact-sorted lists read step by step.

1. Items are dealt into blocks of at most ``BLOCK_TERMS`` terms, so that what tasks hold of the
   items has a bound. Each block is one search over all documents.
2. One pass over the texts stages the items' terms of every document with its length; document
   frequencies, N and L are sums over that table.
3. Documents are searched where they lie, in shards of bounded size. A shard sorts one list per
   term by falling impact. For each item the lists are read in steps; every document has a lower
   bound (what was read) and an upper one (plus the impact each list has come down to, for lists
   that have not shown it). Documents whose upper bound falls below the best lower bounds leave;
   reading ends when the bounds of all others meet. Scores that earlier shards of the task have
   reached are a floor for later ones.
4. The best of each shard are merged by two ranked windows, the first over parts of an item.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Terms of the items that are searched together; an item of more is searched alone.
BLOCK_TERMS = 200_000
#: Postings and documents of one shard.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 8192
#: Postings read from each list in the first step; later steps are twice as long.
FIRST_READ = 64
#: Parts of an item that are ranked apart before the item is.
PARTS = 64

#: ASCII letters and digits are kept (A-Z lower-cased), other ASCII becomes a blank, the rest is part of terms.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``item, item_id, terms``: a row number of each item that has terms."""

    @F.pandas_udf("array<binary>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(terms)

    number, text = F.monotonically_increasing_id().alias("item"), whole(text_col).alias("text")
    rows = items.select(number, F.col(item_col).alias("item_id"), text)
    return rows.select("item", "item_id", split("text").alias("terms")).filter(F.size("terms") > 0)


def _blocks(items: DataFrame) -> list[list]:
    """Conditions that deal the items into blocks of ``BLOCK_TERMS`` terms at most, or one item."""
    parts = 1
    while True:
        key = F.pmod(F.xxhash64("item"), F.lit(parts))
        sizes = items.groupBy(key.alias("part")).agg(F.sum(F.size("terms")).alias("terms"), F.count("*").alias("items"))
        rows = sizes.collect()
        if all(r["terms"] <= BLOCK_TERMS or r["items"] == 1 for r in rows):
            return [key == r["part"] for r in rows]
        parts *= 2


def _document_terms(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document with a term: its length, and which of ``words``
    it holds how often, as packed 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    some = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kind = some.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            n, held, counts = [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                ids = np.array([i for i in map(number.get, found) if i is not None], dtype="<i4")
                ids, times = np.unique(ids, return_counts=True)
                n.append(len(found))
                held.append(ids.tobytes())
                counts.append(times.astype("<i4").tobytes())
            made = [pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n", "terms", "counts"])

    made = some.mapInArrow(run, f"doc_id {kind}, n long, terms binary, counts binary")
    return made.filter("n > 0")


def _document_frequencies(held: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4")
            df += np.bincount(ids, minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, dtype=np.int64)
    counted = held.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = counted.toPandas()
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none exceeds the size of a shard (one document may)."""
    for batch in batches:
        postings = pc.binary_length(batch.column("terms")).to_numpy(zero_copy_only=False) // 4
        low = size = 0
        for i, p in enumerate(postings.tolist()):
            if i > low and (size + p > SHARD_POSTINGS or i - low >= SHARD_DOCS):
                yield batch.slice(low, i - low)
                low, size = i, 0
            size += p
        if len(batch) > low:
            yield batch.slice(low)


class Lists:
    """The impact-sorted lists of one shard."""

    def __init__(self, shard: pa.RecordBatch, weights: np.ndarray, documents: int, length: int):
        held = shard.column("terms").to_pylist()
        term = np.frombuffer(b"".join(held), dtype="<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(shard.column("counts").to_pylist()), dtype="<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(held)), [len(b) // 4 for b in held])
        n = shard.column("n").to_numpy(zero_copy_only=False)
        m = 100 - 25 + (25 * n * documents) // length
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        some = np.flatnonzero(impact)
        some = some[np.lexsort((-impact[some], term[some]))]
        self.doc, self.impact = doc[some], impact[some]
        self.bounds = np.searchsorted(term[some], np.arange(len(weights) + 1))
        self.size = len(held)

    def best(self, query: np.ndarray, times: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can be among the ``top`` of a query, ties included,
        and reach ``floor``.

        Lower bounds only grow and upper ones only fall, so a document that leaves never returns.
        """
        at, end = self.bounds[query].copy(), self.bounds[query + 1]
        lists = np.flatnonzero(at < end)
        at, end, times = at[lists], end[lists], times[lists]
        lower = np.zeros(self.size, dtype=np.int64)
        seen = np.zeros((len(lists), self.size), dtype=bool)
        frontier = self.impact[at] * times
        left = np.arange(self.size)
        step = FIRST_READ
        while len(left) and frontier.any():
            for i in np.flatnonzero(at < end).tolist():
                stop = min(at[i] + step, end[i])
                docs, impacts = self.doc[at[i] : stop], self.impact[at[i] : stop] * times[i]
                lower[docs] += impacts
                seen[i, docs] = True
                at[i] = stop
                frontier[i] = self.impact[stop] * times[i] if stop < end[i] else 0
            open_lists = np.flatnonzero(frontier)
            unread = frontier.sum() - frontier[open_lists] @ seen[np.ix_(open_lists, left)]
            kth = np.partition(lower[left], -top)[-top] if len(left) >= top else 0
            stays = lower[left] + unread >= max(kth, floor, 1)
            left = left[stays]
            if not unread[stays].any():
                break
            step *= 2
        left = left[lower[left] > 0]
        return left, lower[left]


def _search(
    held: DataFrame, queries: list[tuple], weights: np.ndarray, documents: int, length: int, top: int
) -> DataFrame:
    """``item, doc_id, score``: the best documents of every shard for each of ``queries``."""
    sent = held.sparkSession.sparkContext.broadcast((queries, weights))
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        reached = np.zeros((len(queries), top), dtype=np.int64)  # best scores so far, falling
        for shard in _shards(batches):
            ids = shard.column("doc_id")
            rank = np.empty(len(shard), dtype=np.int64)
            rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(shard))
            lists = Lists(shard, weights, documents, length)
            items, places, scores = [], [], []
            for k, (item, query, times) in enumerate(queries):
                found, score = lists.best(query, times, top, int(reached[k, -1]))
                order = np.lexsort((rank[found], -score))[:top]
                items.append(np.full(len(order), item, dtype=np.int64))
                places.append(found[order])
                scores.append(score[order])
                reached[k] = -np.sort(-np.concatenate((reached[k], score[order])))[:top]
            items, places, scores = (pa.array(np.concatenate(x)) for x in (items, places, scores))
            yield pa.RecordBatch.from_arrays([items, ids.take(places), scores], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, f"item long, doc_id {kind}, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 20,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0.

    Equal scores are ranked by rising ``doc_id``, missing ids last. Missing text has no terms;
    documents and items without terms give no rows. Every row of ``docs`` is a document and every
    row of ``items`` an item, also where ids repeat. Other columns are ignored. No documents or no
    items, no rows.
    """
    spark = docs.sparkSession
    asked = staged(_item_terms(items, item_id_col, item_text_col), "items")
    out = None
    for block in _blocks(asked):
        rows = asked.filter(block).select("item", "terms").collect()
        words = sorted({bytes(t) for r in rows for t in r["terms"]})
        number = {w: i for i, w in enumerate(words)}
        queries = [
            (r["item"], *np.unique([number[bytes(t)] for t in r["terms"]], return_counts=True)) for r in rows
        ]
        held = staged(_document_terms(docs, words, id_col, text_col), "terms")
        total = held.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not total["documents"]:
            break
        df = _document_frequencies(held, len(words))
        weights = np.floor(1000 * np.log((2 * total["documents"] + 2) / (2 * df + 1))).astype(np.int64)
        found = _search(held, queries, weights, total["documents"], total["length"], top)
        out = found if out is None else out.union(found)
    if out is None:
        kinds = (asked.schema["item_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString())
        return spark.createDataFrame([], "item_id {}, rank int, doc_id {}, score long".format(*kinds))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    for keys in (["item", "part"], ["item"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        out = out.withColumn("part", part).withColumn("rank", place).filter(F.col("rank") <= top).drop("part")
    return asked.select("item", "item_id").join(out, "item").select("item_id", "rank", "doc_id", "score")
