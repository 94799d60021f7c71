"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` bytes of its UTF-8. Each passage is described by
the shape of its text: how often one class of bytes follows another, and how much of it stands
earlier in the document. A layer encodes every passage; gated attention, learned from the
labels of whole documents, weighs the codes; their weighted mean is scored. The encoder, the
attention and the score are fitted together by synchronous gradient descent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged, whole
from gaugeflow.plans.gradient import Adam, summed_gradient

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Bytes of a passage, bytes of the pieces whose repeats are counted, bytes described at once.
PASSAGE, PIECE, SLICE = 1024, 16, 1 << 20

#: Classes of bytes: letters, capitals, digits, blanks, line ends, other controls, stops, loud stops, quotes and
#: brackets, dashes, marks, bars, angles, escapes, and bytes of characters beyond ASCII.
_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", bytes([*range(10), *range(11, 32), 127]),
    b".,;:", b"!?", b"\"'()[]", b"-_/", b"#$%&*+=^~@", b"|", b"<>", b"\\{}`", bytes(range(128, 256)),
]
CLASSES = len(_GROUPS)
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _bytes in enumerate(_GROUPS):
    _CLASS[list(_bytes)] = _i
WIDTH = CLASSES * CLASSES + CLASSES + 2

HIDDEN, GATES = 24, 12
#: Tasks of one step of the fit.
TASKS = 12


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(passages x WIDTH, passages of each text)``; an empty text is one passage of zeros."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-size // PASSAGE))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    text = np.repeat(np.arange(len(texts)), size)
    within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    passage = np.repeat(np.cumsum(counts) - counts, size) + within // PASSAGE
    n = int(counts.sum())
    kind = _CLASS[data]
    length = np.bincount(passage, minlength=n)
    share = 1 / np.maximum(length, 1)[:, None]
    one = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    pair = np.flatnonzero(passage[1:] == passage[:-1])
    two = np.bincount(
        (passage[pair] * CLASSES + kind[pair]) * CLASSES + kind[pair + 1], minlength=n * CLASSES * CLASSES
    ).reshape(n, CLASSES * CLASSES)
    repeats = _repeated(data, text, passage, n)
    columns = [np.sqrt(two * share), np.sqrt(one * share), repeats[:, None] * share, np.log1p(length)[:, None] / 7]
    return np.concatenate(columns, axis=1).astype(np.float32), counts


def _repeated(data: np.ndarray, text: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Per passage, the places whose ``PIECE`` bytes also stand earlier in the text."""
    starts = len(data) - PIECE + 1
    if starts <= 0:
        return np.zeros(n)
    hashes = np.zeros(starts, dtype=np.uint64)
    for i in range(PIECE):
        hashes = hashes * np.uint64(0x100000001B3) + data[i : i + starts]
    inside = np.flatnonzero(text[PIECE - 1 :] == text[:starts])
    mixed = (hashes[inside] ^ (text[inside].astype(np.uint64) << np.uint64(40))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed, kind="stable")
    again = np.zeros(len(inside), dtype=bool)
    again[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    return np.bincount(passage[inside[again]], minlength=n).astype(float)


def _slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in slices of about ``SLICE`` bytes."""
    some, size = [], 0
    for t in texts:
        t = t.as_py().encode()
        if some and size + len(t) > SLICE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


@dataclass
class Network:
    """Encoder, gated attention and score on one flat vector of weights."""

    mean: np.ndarray
    std: np.ndarray

    SHAPES = ((WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,))

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return out

    def start(self, seed: int) -> np.ndarray:
        """Small random weights; the score's are zero, so an unfitted network says 0.5."""
        rng = np.random.default_rng(seed)
        drawn = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in self.SHAPES]
        drawn[4] = rng.normal(0, 1 / np.sqrt(GATES), GATES)
        return np.concatenate([d.ravel() for d in drawn])

    def forward(self, flat: np.ndarray, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Codes ``h``, attention ``a`` within each document, its representation ``z`` and score ``p``."""
        w, b, v, u, e, s, c = self.parts(flat)
        first = np.cumsum(counts) - counts
        x = (x - self.mean) / self.std
        h = np.tanh(x @ w + b)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        a = (t * g) @ e
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), counts))
        a /= np.repeat(np.add.reduceat(a, first), counts)
        z = np.add.reduceat(a[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(z @ s + c, -50, 50)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p}

    def gradient(
        self, flat: np.ndarray, x: np.ndarray, counts: np.ndarray, y: np.ndarray
    ) -> tuple[np.ndarray, float, int]:
        """Summed gradient of the log-loss, the loss, and the number of documents."""
        w, b, v, u, e, s, c = self.parts(flat)
        f = self.forward(flat, x, counts)
        first, p = np.cumsum(counts) - counts, f["p"]
        off = p - y
        dz = np.repeat(off[:, None] * s, counts, axis=0)
        da = (f["h"] * dz).sum(axis=1)
        dlogit = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), counts))
        through = dlogit[:, None] * e
        dt, dg = through * f["g"] * (1 - f["t"] ** 2), through * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dz + dt @ v.T + dg @ u.T
        dh = dh * (1 - f["h"] ** 2)
        grads = [
            f["x"].T @ dh, dh.sum(axis=0), f["h"].T @ dt, f["h"].T @ dg, (f["t"] * f["g"]).T @ dlogit,
            f["z"].T @ off, np.array([off.sum()]),
        ]
        q = np.clip(p, 1e-12, 1 - 1e-12)
        loss = -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum()
        return np.concatenate([g.ravel() for g in grads]), float(loss), len(y)


def _unpacked(blobs) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(b) // (4 * WIDTH) for b in blobs])
    return np.frombuffer(b"".join(bytes(b) for b in blobs), dtype="<f4").reshape(-1, WIDTH).astype(float), counts


def _described(texts: DataFrame) -> DataFrame:
    """``y, x``: the label and the packed passages of each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for some in _slices(batch.column("text")):
                x, counts = describe(some)
                ends = np.cumsum(counts).tolist()
                blobs += [x[a:b].tobytes() for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(blobs, pa.binary())], names=["y", "x"])

    return texts.select("y", "text").mapInArrow(run, "y double, x binary")


def remainder(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 4; a missing id counts as empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4


@dataclass
class PassageQuality:
    """The fitted network; ``transform`` scores whole texts where they lie."""

    network: Network
    weights: np.ndarray
    losses: list[float]

    def scored(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """``doc_id, score``, one row per row of ``docs``; missing text is empty text. No shuffle."""
        network, weights = self.network, self.weights
        some = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [network.forward(weights, *describe(t))["p"] for t in _slices(batch.column("text"))]
                if scores:
                    columns = [batch.column("doc_id"), pa.array(np.concatenate(scores))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score"])

        kind = some.schema["doc_id"].dataType.simpleString()
        return some.mapInArrow(run, f"doc_id {kind}, score double")


def fit_passage_quality(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    sample: int = 8_000,
    steps: int = 120,
    rate: float = 0.02,
    seed: int = 42,
) -> PassageQuality:
    """Fit on about ``sample`` labelled documents at most, drawn by a hash of id and text.

    Only rows of ``labels`` whose id has another ``remainder`` than 2 are learned from; missing
    labels are left out. Every whole text of the sample is read. Ids that repeat in either table
    give an example per pair of rows, within the same bound. The gradient of each step is summed
    over all tasks. Without labelled rows the model says 0.5 of every text.
    """
    usable = labels.filter((remainder(id_col) != 2) & F.col(label_col).isNotNull())
    known = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    known = _drawn(known, sample, "id", "y")
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    found = staged(texts.join(F.broadcast(known), "id").select("id", "text", "y"), "labelled")
    ready = staged(_described(_drawn(found, sample, "id", "text", "y")), "passages")
    stats = _moments(ready)
    network = Network(*stats)
    weights, adam, losses = network.start(seed), Adam(rate), []

    def gradient(flat: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, float, int]:
        return network.gradient(flat, *_unpacked(frame["x"]), frame["y"].to_numpy())

    ready = ready.coalesce(TASKS).persist()  # at most ``sample`` rows
    try:
        for step in range(steps):
            total, loss, n = summed_gradient(ready, gradient, weights)
            if not n:
                break
            losses.append(loss / n)
            adam.rate = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            weights = adam.move(weights, total / n)
    finally:
        ready.unpersist()
    return PassageQuality(network, weights, losses)


def _drawn(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """``most`` rows of ``df`` or about so many, by a hash of ``keys``; all of them if there are no more."""
    n = df.count()
    share = most / max(n, 1)
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def _moments(ready: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the passages' columns, added up over tasks."""

    def sums(_: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, float, int]:
        x, _ = _unpacked(frame["x"])
        return np.concatenate((x.sum(axis=0), (x * x).sum(axis=0))), 0.0, len(x)

    total, _, n = summed_gradient(ready, sums, np.zeros(2 * WIDTH))
    mean = total[:WIDTH] / max(n, 1)
    spread = np.sqrt(np.maximum(total[WIDTH:] / max(n, 1) - mean**2, 0))
    return mean, np.where(spread > 1e-3, spread, 1.0)


def quality_scores(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.7
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; nothing but the text enters a score.

    ``held_out`` rows are those whose labels are never learned from. Other columns are ignored.
    """
    scored = fit_passage_quality(docs, labels, text_col, id_col).scored(docs, text_col, id_col)
    return scored.select(
        "doc_id",
        (remainder("doc_id") == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
