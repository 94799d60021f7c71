"""Quality rules with thresholds learned from mergeable sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import WORD_RE, staged, text_key, whole, words

#: Shape ratios in thousandths, with the least quartile distance assumed for each: groups of very
#: even texts would else reject harmless deviations.
METRICS = {"word_length": 150, "symbols": 20, "dup_lines": 120}
#: A mean over few words strays: the fences of the word length open by this over the root of the
#: number of words (three standard errors, at a deviation of 2.5 characters between words).
SAMPLING = 7500.0


def text_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts per text: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    ``n_repeat_words`` counts words inside three-word windows that the text holds at least twice.
    Windows are sorted by a 64-bit hash together with their place; neighbours with equal hashes
    repeat. All of it stays within the row: nothing is exploded or shuffled.
    """
    text = whole(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RE))
    split = docs.select(
        F.col(id_col).alias("doc_id"), *keep, text.alias("t"), words(text).alias("w"), lines.alias("lines")
    )
    n = F.size("w")
    window = lambda x, i: F.struct(
        F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")
    )
    hashed = split.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        (F.char_length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(0))), window)).alias("g"),
    )
    twice = F.filter(
        "g", lambda x, j: (x["h"] == F.get("g", j - 1)["h"]) | (x["h"] == F.get("g", j + 1)["h"])
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        places,
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return hashed.select(*[c for c in hashed.columns if c != "g"], covered.cast("long").alias("n_repeat_words"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def shape(counts: DataFrame) -> DataFrame:
    """The ratios of ``METRICS`` in whole thousandths (zero for texts without words)."""
    per = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN 1000 * {a} DIV {b} ELSE 0L END")
    return counts.withColumns(
        {
            "word_length": per("word_chars", "n_words"),
            "symbols": per("n_symbols", "n_words"),
            "dup_lines": per("n_dup_lines", "n_lines"),
        }
    )


def sketch(shaped: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, metric, bucket, n``: a mergeable quantile sketch of every metric per group.

    A bucket keeps the seven leading bits of a value, so it is off by less than 1/64 of the value;
    there are at most 64 buckets per power of two. Merging two sketches adds the counts: the result
    depends neither on the order nor on partitions, and lost tasks repeat it exactly.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])
    return (
        shaped.select(*groups, F.explode(values).alias("x"))
        .select(*groups, "x.metric", _bucket(F.col("x.v")).alias("bucket"))
        .groupBy(*groups, "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def _bucket(v: Column) -> Column:
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    step = F.pow(F.lit(2), drop).cast("long")
    return F.floor(v / step).cast("long") * step


def fences(merged: DataFrame, groups: list[str], spread: float) -> DataFrame:
    """``groups, metric, n, low, high``: quartiles from a sketch, widened by ``spread`` quartile distances."""
    order = Window.partitionBy(*groups, "metric").orderBy("bucket")
    full = Window.partitionBy(*groups, "metric")
    upto = merged.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(full)})
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    quart = upto.groupBy(*groups, "metric").agg(F.first("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))
    least = F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v)])[F.col("metric")]
    gap = spread * F.greatest(F.col("q3") - F.col("q1"), least)
    return quart.select(*groups, "metric", "n", (F.col("q1") - gap).alias("low"), (F.col("q3") + gap).alias("high"))


def _wide(fence: DataFrame, groups: list[str], prefix: str) -> DataFrame:
    """One row per group with all bounds, named ``<prefix>_<metric>_low`` and ``_high``."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return fence.groupBy(*groups).agg(
        F.max("n").alias(f"{prefix}_n"),
        *[pick(m, b).alias(f"{prefix}_{m}_{b}") for m in METRICS for b in ("low", "high")],
    )


def judged(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang: str = "lang",
    source: str = "source",
    spread: float = 3.0,
    min_rows: int = 30,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per row of ``docs``.

    A text passes when it does not fail the base rules and each shape ratio lies within the fences
    of its group: the quartiles plus or minus ``spread`` quartile distances, for the word length
    also three standard errors of a mean over so many words. Fences come from the texts that pass the base rules. A (language, source) group of fewer than ``min_rows`` of them
    uses its language's merged sketch, and a language with fewer than that the sketch of all texts.

    Missing text is empty and fails; missing language or source counts as a group named ``""``.
    Repeated rows are judged, and counted, each. An empty table gives no rows. Every text counts;
    sketches of at most a few hundred buckets per group and metric are combined map-side, so hot
    groups cost no more than others. The fences join on the group: one small row per group,
    broadcast by Spark when it is below the session's threshold.
    """
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "g_lang"), (source, "g_source"))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *groups)
    counts = shape(text_counts(rows, keep=("g_lang", "g_source")))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    counts = counts.withColumn("base_failed", failed)
    return _verdict(counts, spread, min_rows)


def _verdict(counts: DataFrame, spread: float, min_rows: int) -> DataFrame:
    counts = staged(counts, "quality-counts")
    by_source = staged(sketch(counts.filter(~F.col("base_failed")), ["g_lang", "g_source"]), "quality-sketch")
    by_lang = by_source.groupBy("g_lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    own, lang, everything = (
        _wide(fences(merged, keys, spread), keys, p)
        for merged, keys, p in ((by_source, ["g_lang", "g_source"], "s"), (by_lang, ["g_lang"], "l"), (by_all, [], "a"))
    )
    levels = own.join(lang, "g_lang").join(F.broadcast(everything.withColumn("__one", F.lit(1))), F.lit(True))
    bound = lambda m, b: (
        F.when(F.col("s_n") >= min_rows, F.col(f"s_{m}_{b}"))
        .when(F.col("l_n") >= min_rows, F.col(f"l_{m}_{b}"))
        .otherwise(F.col(f"a_{m}_{b}"))
        .alias(f"{m}_{b}")
    )
    limits = levels.select("g_lang", "g_source", *[bound(m, b) for m in METRICS for b in ("low", "high")])
    inside = ~F.col("base_failed")
    for m in METRICS:
        slack = SAMPLING / F.sqrt(F.greatest("n_words", F.lit(1))) if m == "word_length" else F.lit(0.0)
        inside = inside & F.col(m).between(F.col(f"{m}_low") - slack, F.col(f"{m}_high") + slack)
    return counts.join(limits, ["g_lang", "g_source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(inside, F.lit(False)).alias("kept"),
    )


def keep_good(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source", **options
) -> DataFrame:
    """The rows of ``docs`` whose text is kept.

    A verdict depends on text, language and source only, and is joined back on a digest of them: ids
    may be missing or repeat.
    """
    key = text_key(text_col, F.col(lang).cast("string"), F.col(source).cast("string"))
    rows = docs.select(F.col(text_col), F.col(lang), F.col(source), key.alias("__key"))
    bad = judged(rows, text_col, "__key", lang, source, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    return docs.join(bad, key == F.col("__id"), "left_anti")
