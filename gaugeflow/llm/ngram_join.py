"""Near-duplicate texts: Jaccard join on word n-grams through MinHash banding."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.blocks import runs, spanning_forest
from gaugeflow.llm.common import carried, restored, staged, unused, whole
from gaugeflow.plans.graph import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package

#: Members of a bucket, and n-grams of a component, that one task holds at a time (per side).
BUCKET_TILE, GRAM_TILE = 2_000, 4_000_000
#: Standard deviations below the threshold at which a signature still counts as similar.
SLACK = 5.0


def bands_for(threshold: float, recall: float = 0.999, most: int = 128) -> tuple[int, int]:
    """Bands and rows of a signature that pairs at ``threshold`` meet in with probability ``recall``.

    Of all choices with at most ``most`` hashes, the one with the most rows per band (the fewest
    false candidates) that reaches the recall with the fewest bands.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = bands, rows
    return best


class Grams:
    """Hashed n-grams of texts; words are runs of letters and digits, lower-cased."""

    WORD = re.compile(r"\w+")
    REMEMBERED = 500_000

    def __init__(self, n: int):
        import xxhash

        self.n, self.hash, self.known = n, xxhash.xxh3_64_intdigest, {}
        self.mult = np.random.default_rng(11).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        """The distinct n-grams, sorted; all words as one gram where there are fewer than n, none without words."""
        words = self.WORD.findall(text.lower())
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > self.REMEMBERED:
            self.known = {}
        known = self.known
        for w in {w for w in words if w not in known}:
            known[w] = self.hash(w.encode("utf-8", "surrogatepass"))
        ids = np.array([known[w] for w in words], dtype=np.uint64)
        size = min(self.n, len(ids))
        m = len(ids) - size + 1
        out = np.zeros(m, dtype=np.uint64)
        for k in range(size):
            out += ids[k : k + m] * self.mult[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


class Signer:
    """MinHash signatures by multiply-add hashing, with their band keys."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(7)
        k = bands * rows
        self.shape = bands, rows
        self.a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, k, dtype=np.uint64)
        self.salt = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (one per band), and one byte of each minimum."""
        low = None
        for at in range(0, len(grams), 2048):
            h = (grams[at : at + 2048, None] * self.a + self.b).min(axis=0)
            low = h if low is None else np.minimum(low, h)
        keys = (low.reshape(self.shape) * self.salt).sum(axis=1, dtype=np.uint64)
        keys ^= np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return keys.view(np.int64), ((low * self.a) >> np.uint64(56)).astype(np.uint8)


def _row_key(text_col: str, id_col: str) -> Column:
    """A hash of id and text, to read few rows again; rows of equal hash are told apart by their set."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole(text_col))


def signatures(docs: DataFrame, text_col: str, id_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, key, digest, keys, sig`` per row; the last three are null for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        grams, sign = Grams(n), Signer(bands, rows)
        for batch in batches:
            out = []
            for doc, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                g = grams(text)
                if len(g):
                    keys, sig = sign(g)
                    out.append((doc, key, xxhash.xxh3_128_digest(g.tobytes()), keys, sig.tobytes()))
                else:
                    out.append((doc, key, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "key", "digest", "keys", "sig"])

    texts = docs.select(carried(id_col), _row_key(text_col, id_col).alias("key"), whole(text_col).alias("text"))
    made = texts.mapInPandas(run, "doc_id string, key long, digest binary, keys array<long>, sig binary")
    return restored(made, docs, id_col)


def similar_signatures(sets: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` that connect all sets that share a band key and agree in ``least`` of their bytes.

    Every member of a bucket is compared with the bucket's least member, which settles a bucket of
    near copies with one row per member however large it is. Only buckets where that leaves members
    over are compared in full, by tiles of ``BUCKET_TILE`` members a side, and tiles answer with the
    links of a spanning forest, not with pairs.
    """
    flat = sets.select("rep", F.explode("keys").alias("key"))
    shared = flat.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("center")).filter("n > 1")
    members = staged(flat.join(shared, "key"), "ngram-buckets")
    sig = sets.select("rep", "sig")
    seen = members.join(sig, "rep")
    centers = members.select("center").distinct().join(sig.select(F.col("rep").alias("center"), F.col("sig").alias("csig")), "center")

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), -1)
        return pd.Series((x == np.frombuffer(b"".join(b), dtype=np.uint8).reshape(x.shape)).mean(axis=1))

    # a pair met in several buckets is compared once
    stars = seen.select("rep", "sig", "center").dropDuplicates(["rep", "center"]).join(centers, "center")
    near = staged(stars.select("rep", "center", (agreement("sig", "csig") >= least).alias("near")), "ngram-stars")
    over = members.join(near.filter("NOT near"), ["rep", "center"], "left_semi").select("key").distinct()

    odd = members.join(over, "key")
    chunks = F.ceil(F.col("n") / BUCKET_TILE).cast("int")
    own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    tiled = (
        odd.select("key", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("key", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(sig, "rep")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["key", "i", "j"]):
            yield pd.DataFrame(forest_of_tile(group, least), columns=["a", "b"])

    kind = sets.schema["rep"].dataType.simpleString()
    rest = (
        tiled.repartition(F.col("key"), F.col("i"), F.col("j"))
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(run, f"a {kind}, b {kind}")
    )
    linked = near.filter("near AND rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b"))
    return linked.union(rest).distinct()


def forest_of_tile(group: pd.DataFrame, least: float) -> list[tuple]:
    """Links of a tile: each member not yet reached is compared with all others, breadth first."""
    reps = group["rep"].to_numpy()
    sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(len(reps), -1)
    open_, out = np.ones(len(reps), dtype=bool), []
    for start in range(len(reps)):
        if not open_[start]:
            continue
        open_[start], queue = False, [start]
        while queue and open_.any():
            x = queue.pop()
            left = np.flatnonzero(open_)
            hit = left[(sig[left] == sig[x]).mean(axis=1) >= least]
            open_[hit] = False
            queue += hit.tolist()
            out += [(reps[x], reps[y]) for y in hit]
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], block: int = 1024, width: int = 4096) -> Iterator[tuple]:
    """Shared n-grams of every left and right set, a block of each at a time: ``(i, j, counts)``.

    Only n-grams held by two sets matter; they become columns of 0/1 blocks that are multiplied.
    """
    same = left is right
    sets = left if same else [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = df[column] > 1
    owner, column = owner[use], column[use]
    number = np.cumsum(df > 1) - 1
    column = number[column]
    starts = np.searchsorted(owner, np.arange(len(sets) + 1))
    total = int((df > 1).sum())

    def dense(a: int, b: int, at: int) -> np.ndarray:
        rows, cols = owner[starts[a] : starts[b]] - a, column[starts[a] : starts[b]] - at
        inside = (cols >= 0) & (cols < width)
        out = np.zeros((b - a, min(width, total - at)), dtype=np.float32)
        out[rows[inside], cols[inside]] = 1
        return out

    shift = 0 if same else len(left)
    for i in range(0, len(left), block):
        ie = min(i + block, len(left))
        for j in range(i if same else 0, len(right), block):
            je = min(j + block, len(right))
            counts = np.zeros((ie - i, je - j), dtype=np.float32)
            for at in range(0, total, width):
                x = dense(i, ie, at)
                counts += x @ (x if same and i == j else dense(shift + j, shift + je, at)).T
            yield i, j, counts


def verify_tile(group: pd.DataFrame, threshold: float) -> list[tuple]:
    """Links of a component's tile: rows ``(a, None, links)`` with counts, and ``(a, b, 0)`` of a forest."""
    i, j = group["i"].iloc[0], group["j"].iloc[0]
    reps = group["rep"].to_numpy()
    sets = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
    side = (group["own"] == i).to_numpy()
    first = np.flatnonzero(side)
    second = first if i == j else np.flatnonzero(~side)
    if not len(first) or not len(second):
        return []
    left = [sets[x] for x in first]
    right = left if i == j else [sets[x] for x in second]
    size = np.array([len(s) for s in sets], dtype=np.float64)
    links, ends = np.zeros(len(reps), dtype=np.int64), ([], [])
    for at, bt, shared in overlaps(left, right):
        a, b = first[at : at + shared.shape[0]], second[bt : bt + shared.shape[1]]
        hit = shared >= threshold * (size[a][:, None] + size[b][None, :] - shared) - 1e-9
        if i == j and at == bt:
            hit = np.triu(hit, 1)
        x, y = np.nonzero(hit)
        links += np.bincount(a[x], minlength=len(reps)) + np.bincount(b[y], minlength=len(reps))
        forest = spanning_forest(a[x], b[y])
        ends[0].extend(f[0] for f in forest)
        ends[1].extend(f[1] for f in forest)
    out = [(reps[x], None, int(links[x])) for x in np.flatnonzero(links)]
    forest = spanning_forest(np.array(ends[0], dtype=np.int64), np.array(ends[1], dtype=np.int64))
    return out + [(reps[x], reps[y], 0) for x, y in forest]


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, n_copies, class_no``.

    Two texts are linked when the Jaccard similarity of their sets of word n-grams is at least
    ``threshold``. ``class_id`` is the least id among all texts connected by links, ``n_links`` the
    number of other sets linked to the text's own, ``n_copies`` the number of other rows with
    exactly its set. A text of one to ``n - 1`` words has one gram, made of all its words, so equal
    short texts are copies of each other. Missing text is empty; texts without words have no grams
    and stay alone. Repeated rows are copies of each other. Ids may repeat with other texts, which
    then are other sets: ``class_no``, any number, tells classes of one least id apart (null for
    texts without words). Rows without id are linked as others are; a class that has no id at all
    has a missing ``class_id``. An empty table gives no rows.

    1. One pass makes MinHash signatures, with bands and rows chosen for ``recall`` at the threshold.
       Rows with equal sets are one set from here on, known by the number of its first row.
    2. Sets that share a band key, and whose signatures agree almost as well as the threshold asks
       (five standard deviations of leeway), are connected.
    3. Each component's full n-gram sets are read once, and all its pairs are verified, in tiles of
       bounded size. Tiles answer with counts and with a spanning forest, so no pair becomes a row;
       components larger than a tile are compared tile by tile.
    """
    bands, rows = bands_for(threshold, recall)
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / (bands * rows))
    sign = signatures(docs, text_col, id_col, n, bands, rows)
    sign = staged(sign.withColumn("row", F.monotonically_increasing_id()), "ngram-signatures")
    first = F.min(F.struct("row", "key"))
    classes = sign.filter("digest IS NOT NULL").groupBy("digest").agg(
        first.alias("f"), F.min("doc_id").alias("least_id"), F.count("*").alias("size"),
        F.first("keys").alias("keys"), F.first("sig").alias("sig"),
    )
    classes = staged(
        classes.select("digest", F.col("f.row").alias("rep"), F.col("f.key").alias("key"), "least_id", "size", "keys", "sig"), "ngram-sets"
    )
    component = connected_components(similar_signatures(classes, least)).withColumnRenamed("node", "rep")
    component = staged(component.join(classes.select("rep", "key", "digest"), "rep"), "ngram-components")

    grams = _grams_of(docs, component, text_col, id_col, n).join(component.select("digest", "rep", "component"), "digest")
    chunks = grams.groupBy("component").agg(F.ceil(F.sum("n_grams") / GRAM_TILE).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    tiled = (
        grams.join(chunks, "component")
        .select("component", "rep", "grams", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("component", "rep", "grams", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["component", "i", "j"]):
            rows = verify_tile(group, threshold)
            a, b, links = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in (("a", a), ("b", b), ("links", links))})

    found = staged(
        tiled.repartition(F.col("component"), F.col("i"), F.col("j"))
        .sortWithinPartitions("component", "i", "j")
        .mapInPandas(run, "a long, b long, links long"),
        "ngram-links",
    )
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    linked = connected_components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    linked = linked.join(classes.select("rep", "least_id"), "rep")
    named = linked.groupBy("component").agg(F.min("least_id").alias("class_id"))
    linked = linked.select("rep", "component").join(named, "component")
    per_set = (
        classes.select("digest", "rep", "size", "least_id")
        .join(links, "rep", "left")
        .join(linked, "rep", "left")
        .select("digest", F.coalesce("class_id", "least_id").alias("class_id"), "n_links", "size", F.coalesce("component", "rep").alias("class_no"))
    )
    alone = F.when(F.col("class_no").isNull(), F.col("doc_id"))
    return sign.select("doc_id", "digest").join(per_set, "digest", "left").select(
        "doc_id",
        F.coalesce("class_id", alone).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("size") - 1, F.lit(0)).cast("long").alias("n_copies"),
        "class_no",
    )


def _grams_of(docs: DataFrame, component: DataFrame, text_col: str, id_col: str, n: int) -> DataFrame:
    """``digest, n_grams, grams`` (sorted, eight bytes each) of the sets that stand in a component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        make = Grams(n)
        for batch in batches:
            for at in range(0, len(batch), 500):
                grams = [make(t) for t in batch["text"].iloc[at : at + 500]]
                packed = [g.tobytes() for g in grams]
                digests = [xxhash.xxh3_128_digest(p) for p in packed]
                yield pd.DataFrame({"digest": digests, "n_grams": [len(g) for g in grams], "grams": packed})

    texts = docs.select(_row_key(text_col, id_col).alias("key"), whole(text_col).alias("text"))
    wanted = texts.join(component.select("key").distinct(), "key", "left_semi").select("text")
    return staged(wanted.mapInPandas(run, "digest binary, n_grams long, grams binary"), "ngram-grams").dropDuplicates(["digest"])


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least id stays.

    Rows are told apart by a staged number: ids may be missing (such a row stays only where no row of
    its class has one) or repeat.
    """
    number = unused("__row", docs)
    rows = staged(docs.withColumn(number, F.monotonically_increasing_id()), "ngram-rows")
    near = near_duplicates(rows, text_col, number, **options).filter("n_links > 0 OR n_copies > 0")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(number).alias("row"))
    ids = rows.select(F.col(number).alias("doc_id"), order.alias("order"))
    near = staged(near.select("doc_id", "class_no").join(ids, "doc_id"), "ngram-classes")
    first = near.groupBy("class_no").agg(F.min("order").alias("first"))
    drop = near.join(first, "class_no").filter("doc_id <> first.row").select(F.col("doc_id").alias(number))
    drop = staged(drop, "ngram-dropped")  # Spark sees its size: where it is small, texts stay where they lie
    return rows.join(drop, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
