"""A training corpus from raw documents: filter, clean, de-duplicate, redact and pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import line_dedup, ngram_join, packing, personal, quality
from gaugeflow.llm.common import staged
from gaugeflow.llm.queries import CAPACITY, END_ID


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date after the text has changed (a missing text keeps its count)."""
    if "n_chars" not in docs.columns:
        return docs
    n = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return docs.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines of their source."""
    return _measured(line_dedup.drop_boilerplate(docs).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _measured(personal.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in the training sequences."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(packing.token_pieces(docs, tokenizer, END_ID, CAPACITY), CAPACITY)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]

#: Several stages hash and sketch beyond what SQL says; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
