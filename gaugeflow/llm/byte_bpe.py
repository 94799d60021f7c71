"""Byte-level BPE with a local rank file: encoding, and decoding of the ids to raw bytes.

Ids travel as bytes, four per id, little-endian unsigned.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import carried, restored, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Texts are handed to the library in parts of about this many characters.
PART = 100_000
#: Runs of one kind of character longer than this are matched here, not by the library's regex engine.
LONG_RUN = 10_000
#: Rows that a task turns into one batch of results.
SLICE = 500


def load_encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file that the task can read."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """Cut a text where every match must end: before a space or line feed that follows a
    character which is not white space.

    Each match that holds white space begins with it, so none runs across such a place. A text
    without one stays whole.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = start + size
        while cut < n and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(encoding, text: str) -> np.ndarray:
    """Ids of a whole text, as the library gives them for the undivided text."""
    import regex

    parts = []
    for part in safe_parts(text):
        if regex.search(r"\s{%d}|\S{%d}" % (LONG_RUN, LONG_RUN), part):
            # one match at a time: the library's regex engine has a backtracking limit
            ids = [i for m in regex.finditer(encoding._pat_str, part) for i in encoding._encode_single_piece(m[0])]
        else:
            ids = encoding.encode_ordinary(part)
        parts.append(np.array(ids, dtype="<u4"))
    return np.concatenate(parts)


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """Ids of each text as packed bytes; missing text gives no ids."""
    held: list = []

    @F.pandas_udf("binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held[:] = held or [load_encoding(rank_file, pattern)]
        for batch in texts:
            yield pd.Series([encode_text(held[0], t).tobytes() for t in batch], dtype=object)

    return run(whole(text))


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes behind packed ids; bytes that are not UTF-8 come back as they are."""
    held: list = []

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held[:] = held or [load_encoding(rank_file, pattern)]
        for batch in batches:
            yield pd.Series([held[0].decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in batch], dtype=object)

    return run(F.coalesce(ids, F.lit(b"")))


def token_ids(packed: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.pandas_udf("array<long>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: np.frombuffer(b, "<u4").astype("int64"))

    return run(packed)


def round_trip(
    docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``doc_id, ids, decoded``: every whole text encoded, then its ids decoded.

    Missing text is empty text and has no ids. Repeated rows are encoded each. An empty table
    gives no rows. No shuffle: a row's work depends on that row alone. Both steps run in one pass
    with one copy of the vocabulary, over slices of ``SLICE`` rows, so that a worker holds little.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                ids = [encode_text(encoding, t) for t in part["text"]]
                decoded = [encoding.decode_bytes(i.tolist()) for i in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [i.tobytes() for i in ids], "decoded": decoded})

    texts = docs.select(carried(id_col), whole(text_col).alias("text"))
    return restored(texts.mapInPandas(run, "doc_id string, ids binary, decoded binary"), docs, id_col)
