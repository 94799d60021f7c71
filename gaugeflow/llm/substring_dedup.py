"""Repeated passages: prefix-partitioned suffix trees over windows of words.

A suffix is a window start; trees end at the depth of a window, as nothing below is asked. Of all
suffixes, those matter whose lowest-hashing short part (the anchor) occurs twice in the corpus, as
equal windows have equal anchors. A short prefix, the anchor, splits them into groups; where a group
would outgrow a task, its suffixes are dealt by longer and longer prefixes of their own. Each group's
suffixes are sorted in one task, and neighbours that share a whole window lie under one deep node.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

_WORDS = re.compile("[^\x20\x09-\x0d]+")
#: Words of the shortest prefix, and how many suffix runs a group may hold before longer ones split it.
PREFIX, GROUP = 8, 10_000
#: Prefixes of the window that split larger groups, one after another; behind the whole window
#: stands a single node, whose least place needs no tree.
LONGER = (12, 16)
#: The most frequent keys, looked up from a broadcast table of so many rows instead of a shuffle.
FREQUENT = 1_000
#: Different suffixes that a task folds before it hands them on.
FOLDED = 100_000
#: A run of window starts is one number: its first start times this, plus how many there are.
RUN = 1 << 16
#: Texts whose anchors a task holds before it hands them on.
SLICE = 1_000


class Anchors:
    """For each window of a word sequence, the place of its prefix-length gram with the least hash.

    Equal windows have their anchor at the same offset, so whatever repeats shares an anchor gram.
    """

    REMEMBERED = 500_000

    def __init__(self, window: int, prefix: int = PREFIX):
        import xxhash

        self.window, self.prefix, self.hash, self.known = window, prefix, xxhash.xxh3_64_intdigest, {}
        rng = np.random.default_rng(5)
        self.mult = rng.integers(1, 2**63, prefix, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all grams, and the anchor of each window start."""
        if len(words) < self.window:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.known) > self.REMEMBERED:
            self.known = {}
        known = self.known
        for w in {w for w in words if w not in known}:
            known[w] = self.hash(w.encode("utf-8", "surrogatepass"))
        ids = np.array([known[w] for w in words], dtype=np.uint64)
        m = len(ids) - self.prefix + 1
        grams = np.zeros(m, dtype=np.uint64)
        for k in range(self.prefix):
            grams += ids[k : k + m] * self.mult[k]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0x94D049BB133111EB)
        grams ^= grams >> np.uint64(29)
        views = np.lib.stride_tricks.sliding_window_view(grams, self.window - self.prefix + 1)
        return grams.view(np.int64), views.argmin(axis=1) + np.arange(len(views))


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def anchored_runs(grams: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each anchor, and the run of window starts that have it: ``first * RUN + count``."""
    if not len(anchor):
        return grams, anchor
    first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
    count = np.diff(np.append(first, len(anchor)))
    return grams[anchor[first]], first * RUN + count


def windows_of(first: int, text: str, window: int) -> Iterator[tuple[str, int]]:
    """The windows in a run of words joined by spaces, with their starts."""
    ends = list(accumulate(len(w) + 1 for w in text.split(" ")))
    starts = [0, *ends]
    for i in range(len(ends) - window + 1):
        yield text[starts[i] : ends[i + window - 1] - 1], first + i


def deep_nodes(group: list[tuple[int, int, int, str]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """The nodes at depth ``window`` of the tree over a group's suffixes, as ``(doc, row, start)`` in order.

    ``group`` holds ``(doc, row, first, words)``. The suffixes are sorted; neighbours with a common
    prefix of ``window`` words are leaves of one node. A node of one leaf does not repeat.
    """
    leaves = sorted((path, doc, row, at) for doc, row, first, words in group for path, at in windows_of(first, words, window))
    for _, node in groupby(leaves, key=itemgetter(0)):
        yield [leaf[1:] for leaf in node]


def in_runs(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(row, first start, last start)`` of places ``(row, start)``; consecutive starts share one run."""
    out: list[tuple[int, int, int]] = []
    for row, start in sorted(set(places)):
        if out and out[-1][0] == row and out[-1][2] + 1 == start:
            out[-1] = (row, out[-1][1], start)
        else:
            out.append((row, start, start))
    return out


def later_places(group: list[tuple[int, int, int, str]], window: int) -> list[tuple[int, int, int]]:
    """All places but the least of each deep node."""
    return in_runs([leaf[1:] for node in deep_nodes(group, window) for leaf in node[1:] if leaf != node[0]])


def first_places(group: list[tuple[int, int, int, str]], window: int) -> list[tuple[int, int, int]]:
    """The least place of each deep node."""
    return in_runs([node[0][1:] for node in deep_nodes(group, window)])


def trees(groups: DataFrame, places, window: int) -> DataFrame:
    """``row, lo, hi`` of the ``places`` chosen in each group's tree; a task takes one group at a time."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []
        for batch in batches:
            out = []
            for k, *leaf in zip(batch["key"].tolist(), batch["doc"].tolist(), batch["row"].tolist(), batch["first"].tolist(), batch["words"]):
                if k != key:
                    out += places(group, window)
                    key, group = k, []
                group.append(tuple(leaf))
            yield pd.DataFrame(out, columns=["row", "lo", "hi"])
        yield pd.DataFrame(places(group, window), columns=["row", "lo", "hi"])

    return groups.repartition(F.col("key")).sortWithinPartitions("key").mapInPandas(build, "row long, lo int, hi int")


def with_count(df: DataFrame, key: str, among: list[str], name: str) -> DataFrame:
    """``df`` with ``n``, how often its ``key`` (a long) occurs; for keys over ``GROUP`` the key itself may change.

    Counts are combined before they are shuffled. Rows of the ``FREQUENT`` most frequent keys over
    ``GROUP`` get theirs from a broadcast table and are dealt by a hash of ``among``, which tells
    rows apart; so no other key has more than one in ``FREQUENT`` of all rows in the join. The counts
    grow with the input and are never broadcast.
    """
    counts = staged(df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), name)
    most = counts.filter(F.col("n") > GROUP).orderBy(F.desc("n"), key).limit(FREQUENT)
    marked = df.join(F.broadcast(most.withColumnRenamed("n", "most")), key, "left")
    dealt = marked.withColumn(key, F.when(F.col("most").isNull(), F.col(key)).otherwise(F.xxhash64(*among)))
    return dealt.join(counts.hint("merge"), key, "left").withColumn("n", F.coalesce("most", "n", F.lit(1))).drop("most")


def removed_words(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 20, keep_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``, and with ``keep_text``
    ``kept``, the words left of a text that loses some but not all (null for others).

    A word is removed when a window of ``window`` consecutive words that covers it also starts
    earlier: in a row of smaller id, or earlier in the same text. Windows are judged on the input.
    ``kept_sha256`` digests the words that stay, joined by one space. Missing text has no words;
    texts of fewer than ``window`` words stay whole. Of rows that repeat an id, one counts as the
    earlier. Ids are integers; missing ones count as smaller than all others. An empty table
    gives no rows.

    Texts of equal words are settled by their digest: all but the first go whole. For the others,
    occurrences of anchors are counted (map-side combined) and looked up, which leaves the runs of
    windows behind repeated anchors; only texts with such runs are read again. Behind an anchor with
    at most ``GROUP`` runs, one task builds the tree and gives the later places. Behind a more
    frequent one, tasks first fold equal suffixes into their least place; what is left is dealt by
    the shortest prefix of 12, 16 and then all words that at most ``GROUP`` of them share, and trees
    give the first places: of those windows all others go. So no group has to fit into a task.
    """
    void = F.col(id_col).isNull()
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    texts = docs.select(doc.alias("doc"), void.alias("void"), whole(text_col).alias("text")).withColumn("key", F.sha2("text", 256))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, columns = Anchors(window), ["doc", "void", "key", "n_words", "digest", "grams", "runs"]
        for batch in batches:
            rows = []
            for doc, void, key, text in zip(batch["doc"], batch["void"], batch["key"], batch["text"]):
                words = _WORDS.findall(text)
                rows.append((doc, void, key, len(words), digest(words), *anchored_runs(*find(words))))
                if len(rows) >= SLICE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    scanned = texts.mapInPandas(scan, "doc long, void boolean, key string, n_words long, digest string, grams array<long>, runs array<long>")
    scanned = staged(scanned.withColumn("row", F.monotonically_increasing_id()), "substring-scan")
    firsts = scanned.groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("f"))
    firsts = staged(firsts.select(F.col("f.row").alias("row")), "substring-firsts")
    # copies are fewer than first texts, mostly few enough to be broadcast: then the anchors stay where they are
    copies = staged(scanned.select("row").join(firsts, "row", "left_anti"), "substring-copies")

    found = scanned.select("row", "grams", "runs").join(copies, "row", "left_anti").select(
        "row", F.explode(F.arrays_zip(F.col("grams").alias("gram"), F.col("runs").alias("run"))).alias("a")
    ).select("row", "a.gram", "a.run")
    repeated = with_count(found, "gram", ["row", "run"], "substring-anchors").filter("n > 1")
    run = F.struct("gram", "run", (F.col("n") > GROUP).alias("hot"))
    marked = repeated.groupBy("row").agg(F.collect_list(run).alias("runs")).join(scanned.select("row", "doc", "key"), "row")
    each = texts.groupBy("doc", "key").agg(F.first("text").alias("text"))  # rows that repeat id and text are one
    cold, hot = (F.filter("runs", lambda r: ~r["hot"]), F.filter("runs", lambda r: r["hot"]))
    read = each.join(marked, ["doc", "key"]).select("row", "doc", cold.alias("cold"), hot.alias("hot"), "text")
    read = staged(read, "substring-texts")

    def behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "row", "doc", "first", "words"]
        for batch in batches:
            rows = []
            for row, doc, grams, runs, text in zip(batch["row"], batch["doc"], batch["gram"], batch["run"], batch["text"]):
                words = _WORDS.findall(text)
                for gram, run in zip(grams.tolist(), runs.tolist()):
                    first, count = divmod(run, RUN)
                    rows.append((gram, row, doc, first, " ".join(words[first : first + count + window - 1])))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[str, tuple[int, int, int]] = {}

        def folded() -> pd.DataFrame:
            return pd.DataFrame([(*at, w) for w, at in least.items()], columns=["doc", "row", "first", "words"])

        for batch in batches:
            for row, doc, runs, text in zip(batch["row"].tolist(), batch["doc"].tolist(), batch["run"], batch["text"]):
                words = _WORDS.findall(text)
                for run in runs.tolist():
                    first, count = divmod(run, RUN)
                    for at in range(first, first + count):
                        w, place = " ".join(words[at : at + window]), (doc, row, at)
                        known = least.get(w)
                        if known is None or place < known:
                            least[w] = place
                    if len(least) > FOLDED:
                        yield folded()
                        least = {}
        yield folded()

    cold = read.filter(F.size("cold") > 0).select("row", "doc", "cold.gram", "cold.run", "text")
    spans = trees(cold.mapInPandas(behind, "key long, row long, doc long, first int, words string"), later_places, window)

    # behind a frequent anchor: longer prefixes, and the first places in place of the later ones
    hot = read.filter(F.size("hot") > 0).select("row", "doc", "hot.run", "text")
    rest = staged(hot.mapInPandas(fold, "doc long, row long, first int, words string"), "substring-suffixes")
    groups, place = None, ["doc", "row", "first"]
    for n in LONGER:
        dealt = rest.withColumn("key", F.xxhash64(F.lit(n), F.substring_index("words", " ", n)))
        dealt = staged(with_count(dealt, "key", place, f"substring-prefixes-{n}"), f"substring-dealt-{n}")
        small = dealt.filter(F.col("n") <= GROUP).select("key", *place, "words")
        groups = small if groups is None else groups.union(small)
        rest = dealt.filter(F.col("n") > GROUP).select(*place, "words")
    one = rest.groupBy("words").agg(F.min(F.struct(*place)).alias("f")).select("f.row", F.col("f.first").alias("lo"), F.col("f.first").alias("hi"))
    stay = trees(groups, first_places, window).union(one)

    def by_row(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias(name))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            spans = [batch[c] for c in ("later_lo", "later_hi", "first_lo", "first_hi")]
            for row, runs, text, *found in zip(batch["row"], batch["run"], batch["text"], *spans):
                words = _WORDS.findall(text)
                begins = np.zeros(len(words) + 1, dtype=bool)
                for run in runs.tolist():
                    lo, count = divmod(run, RUN)
                    begins[lo : lo + count] = True
                for lows, highs, repeats in ((*found[2:], False), (*found[:2], True)):
                    if lows is not None:
                        for lo, hi in zip(lows.tolist(), highs.tolist()):
                            begins[lo : hi + 1] = repeats
                covered = begins.astype(np.int64)
                covered[window:] -= begins[:-window]
                gone = (np.cumsum(covered)[:-1] > 0).tolist()
                kept = [w for w, g in zip(words, gone) if not g]
                rows.append((row, len(words) - len(kept), digest(kept), " ".join(kept)))
            out = pd.DataFrame(rows, columns=["row", "n_removed", "kept_sha256", "kept"])
            yield out if keep_text else out.drop(columns="kept")

    schema = "row long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    # few texts change: where these runs are small enough to be broadcast, the other texts stay where they are
    decided = staged(by_row(spans, "later").join(by_row(stay, "first"), "row", "full"), "substring-decided")
    known = read.filter(F.size("hot") == 0).join(decided, "row").unionByName(
        read.filter(F.size("hot") > 0).join(decided, "row", "left")
    )
    judged = known.select(
        "row", "hot.run", "text", *[F.col(f"{name}.{end}").alias(f"{name}_{end}") for name in ("later", "first") for end in ("lo", "hi")]
    )
    changed = judged.mapInPandas(cut, schema)
    rows = scanned.select("row", "doc", "void", "n_words", "digest").join(copies.withColumn("copy", F.lit(True)), "row", "left")
    copied = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    # rows that copy a shorter text stay whole
    rows = rows.join(changed, "row", "left")
    out = [
        F.when(~F.col("void"), F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(digest([]))).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    ]
    return rows.select(*out, *(["kept"] if keep_text else []))
