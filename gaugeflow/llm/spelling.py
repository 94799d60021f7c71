"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

1. Words are counted per task and summed by one shuffle; frequent ones are staged.
2. Every length has its own blocked Bloom filter, merged by a native ``bit_or`` per block. The
   filters are broadcast in passes of at most ``PASS_BYTES``, so what is sent has a bound that
   does not follow the vocabulary.
3. Each word generates its deletions and replacements (an insertion is a deletion seen from the
   other side). Hashes of edits come from the word's own hash, a whole batch at a time; only
   edits that a filter holds become strings and shuffle to the exact join with the vocabulary.
4. A word's form points to a word at least ``ratio`` times as frequent, so chains are short:
   they are followed by pointer doubling until nothing moves.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Words that a task counts before it hands them on.
HELD_WORDS = 1_000_000
#: Bits of a filter per word; a block has four 64-bit words and gets one bit in each from a word.
BITS_PER_WORD, BLOCK_BITS = 16, 256
#: Bytes of filters that are broadcast at once.
PASS_BYTES = 32 << 20
#: Edits probed at once.
PROBES = 1 << 20
#: Words whose edits are generated together.
SLICE = 4096

#: One byte per Latin-1 character: letters A-Z lower-cased, letters kept, all else a blank.
_LETTER = [c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0]
_RUNS = bytes((c + 32 if c <= 90 else c) if c in _LETTER else 32 for c in range(256))

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, a Latin-1 byte per code point."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def word_counts(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", typo_every: int = 199, min_length: int = 6
) -> DataFrame:
    """``word, n``: words of ``min_length`` code points and their occurrences in all whole texts.

    Where ``typo_every`` divides the unsigned crc32 of ``<id>:<run>``, the run has lost one letter
    (0: never). Missing text has no words; a missing id hashes as an empty one. Repeated rows
    count each. Tasks add up what they have seen before the shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: defaultdict[bytes, int] = defaultdict(int)

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
            held.clear()
            return made

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                start = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(letter_runs(text)).items():
                    if len(word) < min_length:
                        continue
                    if typo_every:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), whole(text_col).alias("text"))
    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(length: int) -> np.ndarray:
    out = np.ones(length, dtype=np.uint64)
    out[1:] = BASE
    return np.cumprod(out, dtype=np.uint64)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; the last column is the word's own."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    np.cumsum(codes * _powers(codes.shape[1]), axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash among ``blocks``, and the mixed hash that names its four bits."""
    mixed = _mix(hashes)
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mixed


def _bit(mixed: np.ndarray, word: int) -> np.ndarray:
    return np.uint64(1) << ((mixed >> np.uint64(6 * word)) & np.uint64(63))


class Shard:
    """The part of one length's filter that a pass holds: blocks ``low`` up to the end of ``table``."""

    def __init__(self, blocks: int, low: int, table: np.ndarray):
        self.blocks, self.low, self.table = blocks, low, table

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of all that the filter may hold."""
        block, mixed = _places(hashes, self.blocks)
        at = np.flatnonzero((block >= self.low) & (block < self.low + len(self.table)))
        for word in range(4):
            bits = _bit(mixed[at], word)
            at = at[self.table[(block[at] - np.uint64(self.low)).astype(np.int64), word] & bits != 0]
        return at


def _probe(words: list[str], letters: np.ndarray, shards: dict[int, Shard]) -> Iterator[tuple[int, str]]:
    """``(place of the word, edit)`` for words of one length and edits that a filter may hold."""
    codes = _codes(words)
    m, length = codes.shape
    shorter, same = shards.get(length - 1), shards.get(length)
    prefix, power = _prefixes(codes), _powers(length)
    own = prefix[:, -1:]
    if shorter:
        # of equal neighbouring letters only the first is deleted: the others give the same word
        differs = np.ones(codes.shape, dtype=bool)
        differs[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(differs)
        hashes = prefix[row, at] + np.uint64(BASE_INVERSE) * (own[row, 0] - prefix[row, at + 1])
        for k in shorter.holds(hashes).tolist():
            word, i = words[row[k]], at[k]
            yield row[k], word[:i] + word[i + 1 :]
    if same:
        step = max(1, PROBES // (m * len(letters)))
        for low in range(0, length, step):
            part = codes[:, low : low + step]
            base = own - part * power[low : low + step]
            hashes = base[:, :, None] + letters[None, None, :] * power[low : low + step][None, :, None]
            row, at, letter = np.nonzero(letters[None, None, :] > part[:, :, None])  # the lesser word makes the pair
            for k in same.holds(hashes[row, at, letter]).tolist():
                word, i = words[row[k]], low + at[k]
                yield row[k], word[:i] + chr(int(letters[letter[k]])) + word[i + 1 :]


def _filter_blocks(vocabulary: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``length, block, b0..b3``: the filters' blocks that are not empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, words in batch.groupby(batch["word"].str.len())["word"]:
                block, mixed = _places(_prefixes(_codes(list(words)))[:, -1], _blocks(counts[length]))
                bits = {f"b{i}": _bit(mixed, i).view(np.int64) for i in range(4)}
                yield pd.DataFrame({"length": length, "block": block.astype(np.int64), **bits})

    made = vocabulary.select("word").mapInPandas(run, "length int, block long, b0 long, b1 long, b2 long, b3 long")
    return made.groupBy("length", "block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)])


def _blocks(words: int) -> int:
    return max(1, math.ceil(words * BITS_PER_WORD / BLOCK_BITS))


def _passes(counts: dict[int, int]) -> list[list[tuple[int, int, int]]]:
    """``(length, first block, end)`` of all filters, dealt into passes of ``PASS_BYTES`` at most."""
    most = max(1, PASS_BYTES * 8 // BLOCK_BITS)
    out: list[list[tuple[int, int, int]]] = []
    free = 0
    for length in sorted(counts):
        low, end = 0, _blocks(counts[length])
        while low < end:
            if not free:
                out.append([])
                free = most
            taken = min(free, end - low)
            out[-1].append((length, low, low + taken))
            low, free = low + taken, free - taken
    return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: both directions of every pair of words one edit apart.

    ``vocabulary`` has ``word, n`` with distinct words and is read several times: stage it. One
    edit is one inserted, deleted or replaced code point. An empty vocabulary gives no rows.
    """
    spark = vocabulary.sparkSession
    rows = vocabulary.groupBy(F.char_length("word").alias("length")).count().collect()
    counts = {r["length"]: r["count"] for r in rows if r["length"]}
    kinds = "word string, n long, other string"
    if not counts:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    chars = vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in chars), dtype=np.uint64)
    blocks = staged(_filter_blocks(vocabulary, counts), "filters")
    found = None
    for part in _passes(counts):
        wanted = [
            (F.col("length") == length) & (F.col("block") >= low) & (F.col("block") < end) for length, low, end in part
        ]
        held = blocks.filter(_any(wanted)).toPandas()
        shards = {}
        for length, low, end in part:
            mine = held[(held["length"] == length) & (held["block"] >= low) & (held["block"] < end)]
            table = np.zeros((end - low, 4), dtype=np.uint64)
            table[mine["block"].to_numpy() - low] = mine[["b0", "b1", "b2", "b3"]].to_numpy().view(np.uint64)
            shards[length] = Shard(_blocks(counts[length]), low, table)
        sent = spark.sparkContext.broadcast((letters, shards))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            letters, shards = sent.value
            for batch in batches:
                for _, group in batch.groupby(batch["word"].str.len()):
                    for low in range(0, len(group), SLICE):
                        words, n = list(group["word"][low : low + SLICE]), group["n"][low : low + SLICE].to_numpy()
                        hits = list(_probe(words, letters, shards))
                        if hits:
                            at, other = zip(*hits)
                            yield pd.DataFrame({"word": [words[i] for i in at], "n": n[list(at)], "other": other})

        lengths = [x for length, _, _ in part for x in (length, length + 1)]
        positive = vocabulary.filter(F.char_length("word").isin(sorted(set(lengths)))).mapInPandas(run, kinds)
        found = positive if found is None else found.union(positive)
    exact = found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    ends = [("word", "n", "other", "other_n"), ("other", "other_n", "word", "n")]
    names = ("word", "n", "near", "near_n")
    sides = F.array(*[F.struct(*[F.col(c).alias(a) for c, a in zip(e, names)]) for e in ends])
    return exact.select(F.inline(sides))


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words that have a form; a form is more frequent, so no chain is a ring."""
    current = staged(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    moved = True
    while moved:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = current.join(ahead, "root", "left")
        step = staged(
            step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        moved = not step.filter("moved").isEmpty()
        current = step.select("word", "root")
    return current


def spelling_forms(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, a row per word of ``vocabulary`` (``word, n``).

    The form is the near word of largest ``n`` (ties: least in code-point order) if that is at
    least ``ratio`` times the word's own, else null; the root is where forms end, the word itself
    if it has none. An empty vocabulary gives no rows.
    """
    words = staged(vocabulary.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    given = -F.col("best.less") >= ratio * F.col("n")
    forms = staged(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(given, F.col("best.near")).alias("form"),
            F.when(given, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    joined = forms.join(_roots(forms), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    typo_every: int = 199,
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
) -> DataFrame:
    """``spelling_forms`` of the words with ``min_count`` occurrences or more in ``docs``.

    Other columns are ignored, whatever their names. No text, no rows.
    """
    counts = word_counts(docs, text_col, id_col, typo_every, min_length).filter(F.col("n") >= min_count)
    return spelling_forms(counts, ratio)
