"""Packing token pieces into sequences: a configuration linear program over the length histogram.

Only the histogram (as many rows as the capacity at most, whatever the size of the corpus) reaches
the driver. The plan made from it says which ranks of a length go to which sequences; pieces then
look themselves up in parallel.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import carried, restored, staged, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000
#: New words that are encoded at a time, and documents whose texts are Python strings at a time.
LEARNED, SLICE = 20_000, 2_000
#: Pieces of one length are ranked in this many independent buckets.
BUCKETS = 1024
#: Knapsack sizes are counted in this many tokens (rounded up).
UNIT = 16
#: Groups of large lengths in the linear program, and the share of the capacity below which
#: lengths are left to best fit.
GROUPS, SMALL = 64, 32
#: Step of the multiplicative weights.
EPSILON = 0.25


class WordEncoder:
    """Ids of a text by a tokenizer that never joins across a space, tab or line end.

    Such a text's ids are the ids of its words one after another, so each word is encoded once. The
    tokenizer lower-cases, and takes a run of letters and a run of marks as pieces of their own:
    texts of Latin-1 characters are therefore lower-cased first, and a full stop or comma between a
    letter and white space counts as a word, which leaves fewer different words.

    Words are remembered by their 128-bit hashes in sorted arrays, about 30 bytes each with their ids.
    """

    LETTERS = re.compile("[a-zà-öø-ÿß]+")
    LAST_MARK = re.compile("(?<=[a-zà-öø-ÿß])[.,](?=[ \n]|$)")

    def __init__(self, file: str):
        import xxhash
        from tokenizers import Tokenizer

        self.hash = xxhash.xxh3_128_digest
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their names within a text are ordinary text
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _spaced(self, text: str) -> str:
        """The text with its words between single spaces."""
        try:
            text.encode("latin-1")
            text = self.LAST_MARK.sub(r" \g<0>", text.lower())
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _forget(self) -> None:
        """No word is known but the empty one."""
        self.high, self.low = self._hashes([""])
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.empty(0, dtype="<u4")

    def _hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join([self.hash(w.encode()) for w in words]), dtype="<u8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, as their first place in ``ids``, to which they are added, and their number.

        Words of letters end where a piece ends, so they are encoded together; others one by one.
        """
        first, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        made, end = [self.ids], len(self.ids)
        alike = [bool(self.LETTERS.fullmatch(w)) for w in new]
        for i in np.flatnonzero(~np.array(alike, dtype=bool)).tolist():
            made.append(self._encode(new[i]))
            first[i], size[i] = end, len(made[-1])
            end += len(made[-1])
        alike = np.flatnonzero(alike)
        for start in range(0, len(alike), LEARNED):
            some = alike[start : start + LEARNED]
            ids = self._encode(" ".join([new[i] for i in some.tolist()]))
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a word of letters does not end where a piece ends")
            first[some], size[some] = end + np.append(0, ends[:-1]), np.diff(ends, prepend=0)
            made.append(ids)
            end += len(ids)
        self.ids = np.concatenate(made)
        return first, size

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words the first place of their ids, and their number."""
        if len(self.high) > REMEMBERED:
            self._forget()
        high, low = self._hashes(words)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        first, size = self.first[at], self.size[at]
        new = np.flatnonzero((self.high[at] != high) | (self.low[at] != low))
        if len(new):
            new = new[np.argsort(high[new])]
            first[new], size[new] = self._learn([words[i] for i in new.tolist()])
            place = np.searchsorted(self.high, high[new])
            for name, column in (("high", high), ("low", low), ("first", first), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), place, column[new]))
        return first, size

    def packed(self, texts: list[str], part: int = 4_000_000) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; texts are taken ``part`` characters at a time."""
        i = 0
        while i < len(texts):
            chars, some = 0, []
            while i < len(texts) and chars < part:
                some.append(self._spaced(texts[i]))
                chars += len(texts[i])
                i += 1
            yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        """Each distinct word is looked up once; its ids are then copied to all its places."""
        split = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        first, size = self._known(words)
        word = coded.indices.to_numpy()
        size_at = size[word]
        end_at = np.cumsum(size_at)
        place = np.arange(end_at[-1]) + np.repeat(first[word] - (end_at - size_at), size_at)
        out = self.ids[place]
        bounds = np.concatenate(([0], end_at))[split.offsets.to_numpy()]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield out[a:b].tobytes()


def task_encoder(file: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps what it remembers from task to task."""
    kept = sys.modules.setdefault("_gaugeflow_worker_state", types.ModuleType("_gaugeflow_worker_state"))
    if file not in kept.__dict__:
        kept.__dict__[file] = WordEncoder(file)
    return kept.__dict__[file]


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int,
    capacity: int = 4096,
    text_col: str = "text",
    id_col: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, four bytes each) of every text.

    A text's ids end with ``end_id``; missing text is empty and has that id alone. Only texts of
    more than ``capacity`` ids are cut, into pieces of that size and a last one of the rest.
    """
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    kinds = dict(doc_id=pa.string(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64())
    kinds |= dict(ids=pa.binary()) if with_ids else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(tokenizer_file)
        slices = (batch.slice(first, SLICE) for batch in batches for first in range(0, batch.num_rows, SLICE))
        for some in slices:
            rows = []
            for doc, packed in zip(some["doc_id"].to_pylist(), encoder.packed(some["text"].to_pylist())):
                packed += end
                for i, at in enumerate(range(0, len(packed), step)):
                    part = packed[at : at + step]
                    row = (doc, i, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    texts = docs.select(carried(id_col), whole(text_col).alias("text"))
    return restored(texts.mapInArrow(run, schema), docs, id_col)


def price(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest weight: counts per size, by dynamic programming over the capacity.

    ``sizes`` ascend. ``best[c]`` is the greatest weight of items of total size ``c`` at most.
    """
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            worth = weights[: fits[c]] + best[c - sizes[: fits[c]]]
            i = int(worth.argmax())
            if worth[i] > best[c]:
                best[c], took[c] = worth[i], i
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, epsilon: float = EPSILON) -> dict[tuple, float]:
    """Configurations and how often each is used, covering ``demand`` (a fractional cover).

    Multiplicative weights: a size weighs less the better it is covered; each round prices the best
    configuration by knapsack and uses it until some size's demand is met once more. When every
    demand is met ``log(m) / epsilon^2`` times, the uses divided by that number solve the covering
    program within a factor of about ``1 + epsilon``.
    """
    covered, uses = np.zeros(len(sizes)), defaultdict(float)
    goal = np.log(max(2, len(sizes))) / epsilon**2
    while covered.min() < goal:
        weights = np.where(covered < goal, np.exp(np.log1p(-epsilon) * (covered - covered.min())), 0.0) / demand
        config = price(weights, sizes, capacity)
        inside = config > 0
        step = (demand[inside] / config[inside]).min()
        uses[tuple(config)] += step
        covered[inside] += step * config[inside] / demand[inside]
    return {config: x / covered.min() for config, x in uses.items()}


class Plan:
    """Ranges of sequences by what is left in them, and where ranges of ranks are placed."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.next_rank, self.capacity = dict(counts), defaultdict(int), capacity
        self.rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> [first, end) of sequences
        self.rooms: list[int] = []  # keys of self.open, ascending
        self.n_sequences = 0
        self.lengths = sorted(x for x, n in counts.items() if n and x < capacity)

    def place(self, length: int, first: int, n: int, offset: int) -> None:
        """Ranks of a length, one in each of ``n`` sequences from ``first``."""
        self.rows.append((length, self.next_rank[length], first, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def keep(self, room: int, first: int, end: int) -> None:
        if first < end and room:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((first, end))

    def longest(self, room: int) -> int:
        """The longest length still left that fits, or 0."""
        while True:
            i = bisect.bisect_right(self.lengths, room)
            if not i or self.left[self.lengths[i - 1]]:
                return self.lengths[i - 1] if i else 0
            del self.lengths[i - 1]

    def fill(self, config: tuple, groups: list[list[int]], n: int) -> None:
        """``n`` new sequences of one configuration.

        Each slot takes its group's longest lengths still left. The last one, and whatever room
        remains because slots were counted at their group's greatest length, takes the longest
        lengths that fit.
        """
        parts = [(self.n_sequences, self.n_sequences + n, 0)]
        self.n_sequences += n
        slots = [g for g in reversed(range(len(config))) for _ in range(config[g])]
        for g in slots[:-1]:
            after = []
            for first, end, used in parts:
                while first < end:
                    length = next((x for x in groups[g] if self.left[x]), 0)
                    if not length:
                        after.append((first, end, used))
                        break
                    k = min(end - first, self.left[length])
                    self.place(length, first, k, used)
                    after.append((first, first + k, used + length))
                    first += k
            parts = after
        while parts:
            first, end, used = parts.pop()
            length = self.longest(self.capacity - used)
            if not length:
                self.keep(self.capacity - used, first, end)
                continue
            k = min(end - first, self.left[length])
            self.place(length, first, k, used)
            parts.append((first, first + k, used + length))
            if first + k < end:
                parts.append((first + k, end, used))

    def best_fit(self) -> None:
        """All that is left, longest first, each into the least room that takes it."""
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while self.left[length]:
                i = bisect.bisect_left(self.rooms, length)
                if i == len(self.rooms):
                    self.open_for(length)
                    continue
                room = self.rooms[i]
                first, end = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    del self.rooms[i]
                k = min(end - first, self.left[length])
                self.place(length, first, k, self.capacity - room)
                self.keep(room, first + k, end)
                self.keep(room - length, first, first + k)

    def open_for(self, length: int) -> None:
        """New sequences for one length: as many full ones as there are, or one for the rest."""
        each = self.capacity // length
        n, each = (self.left[length] // each, each) if self.left[length] >= each else (1, self.left[length])
        for j in range(each):
            self.place(length, self.n_sequences, n, j * length)
        self.keep(self.capacity - each * length, self.n_sequences, self.n_sequences + n)
        self.n_sequences += n


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for a length histogram: rounded configurations first, best fit for the rest.

    Lengths above ``capacity / SMALL`` are cut into at most ``GROUPS`` groups of about equal counts
    and counted at their group's greatest length, so the linear program has few rows whatever the
    histogram. Uses are rounded down; what that leaves, and all small lengths, go by best fit.
    """
    plan = Plan(counts, capacity)
    large = sorted(x for x, n in counts.items() if n and capacity // SMALL < x < capacity)
    total, seen, groups = sum(counts[x] for x in large), 0, []
    for x in large:
        k = seen * GROUPS // max(1, total)
        if not groups or groups[-1][0] != k:
            groups.append((k, []))
        groups[-1][1].append(x)
        seen += counts[x]
    lengths = [sorted(g, reverse=True) for _, g in groups]
    if lengths:
        sizes = np.array([-(-g[0] // UNIT) for g in lengths])
        demand = np.array([float(sum(counts[x] for x in g)) for g in lengths])
        uses = solve(sizes, demand, capacity // UNIT)
        largest_first = sorted(uses.items(), key=lambda u: u[0][::-1], reverse=True)
        for config, x in largest_first:
            left = [sum(plan.left[x] for x in g) for g in lengths]
            n = min(int(x + 1e-9), *(left[g] // c for g, c in enumerate(config) if c))
            if n:
                plan.fill(config, lengths, n)
    plan.best_fit()
    return plan


def packed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``.

    Sequences hold at most ``capacity``; offsets within one are gapless from 0. Lengths must lie
    between 1 and ``capacity``. Repeated rows are placed each. An empty table gives no rows.

    A piece's rank among pieces of its length comes from a window within (length, bucket) and the
    running count of the buckets before, so a length that a third of all pieces share is ranked in
    ``BUCKETS`` tasks. The plan is broadcast: its rows depend on the capacity and the histogram's
    at most ``capacity`` lengths, not on how many pieces there are.
    """
    spark = pieces.sparkSession
    pieces = staged(pieces, "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS))
    marked = pieces.withColumn("__bucket", bucket)
    sizes = staged(marked.groupBy("length", "__bucket").agg(F.count("*").alias("__n")), "piece-counts")
    histogram = sizes.groupBy("length").agg(F.sum("__n").alias("n"))  # at most `capacity` rows
    plan = make_plan({r["length"]: r["n"] for r in histogram.collect()}, capacity)

    rows = np.array(sorted(plan.rows), dtype=np.int64).reshape(-1, 4)
    table = spark.sparkContext.broadcast(((rows[:, 0] << 48) | rows[:, 1], rows[:, 1:]))

    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, values = table.value
        at = np.searchsorted(keys, (length.to_numpy() << 48) | rank.to_numpy(), side="right") - 1
        found = values[at]
        return pd.DataFrame({"sequence_id": found[:, 1] + rank.to_numpy() - found[:, 0], "offset": found[:, 2]})

    look_up = F.pandas_udf(look_up, "sequence_id long, offset long")
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = marked.withColumn("__rank", F.row_number().over(within).cast("long") - 1).join(
        offsets, ["length", "__bucket"]
    )
    placed = ranked.withColumn("__at", look_up(F.col("length"), F.col("__before") + F.col("__rank")))
    return placed.select(*[c for c in pieces.columns], "__at.sequence_id", "__at.offset")
