"""Column expressions and staging shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import scratch_path

#: Characters between words: space and the five ASCII controls from tab to carriage return.
GAP = " \t\n\x0b\x0c\r"
GAP_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, with missing text read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(*texts: str | Column) -> Column:
    """A key of rows whose texts are all equal, for decisions that depend on nothing else."""
    each = [F.sha2(whole(t), 256) for t in texts]
    return each[0] if len(each) == 1 else F.sha2(F.concat(*each), 256)


def carried(id_col: str) -> Column:
    """An id as text: numbers pass through Python whole, also next to missing ones."""
    return F.col(id_col).cast("string").alias("doc_id")


def restored(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """``doc_id`` of ``df`` in the type that it has in ``docs``."""
    return df.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, ``name`` if possible."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Array of words; empty for a text without any."""
    inner = F.btrim(text, F.lit(GAP))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP_RE))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the cluster's shared folder and read again.

    Cuts the lineage in a way that survives lost executors, and keeps columns apart so that
    later passes read only what they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
