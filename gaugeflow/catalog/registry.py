"""Registry of queries and the inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(tables) -> DataFrame``; ``tables(name)`` reads one table."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


class Tables:
    """Readers for the Parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def series(self) -> DataFrame:
        """Measurements per event type, with the -200 sentinel in every 33rd reading."""
        v = F.when(F.col("event_id") % 33 == 0, F.lit(-200.0)).otherwise(F.col("value"))
        return self("events").select("event_type", "ts", "event_id", v.alias("v"))

    def gaps(self) -> DataFrame:
        """The same series with missing readings and one long gap in every 1,000 ids."""
        eid = F.col("event_id")
        hole = (eid % 33 == 0) | (eid % 1000 < 60)
        v = F.when(~hole, F.col("value"))
        return self("events").select("event_type", "ts", "event_id", v.alias("v"))

    def scores(self) -> DataFrame:
        """Labelled documents with a score, one 'model' per language."""
        n = F.col("n_chars")
        return (
            self("labels")
            .join(self("documents").select("doc_id", "lang", "n_chars"), "doc_id")
            .select("doc_id", F.col("lang").alias("model"), F.col("quality").alias("y"), (n / (n + 1000.0)).alias("p"))
        )

    def line_scores(self) -> DataFrame:
        """Line items as scored rows: label is a return, score grows with the price."""
        x = F.col("l_extendedprice")
        return self("lineitem").select(
            F.col("l_linestatus").alias("model"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            (x / (x + 30000.0)).alias("p"),
        )

    def fits(self) -> DataFrame:
        """Line items as truth and prediction of a price, per return flag."""
        return self("lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"),
            F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"),
        )

    def vectors(self) -> DataFrame:
        """Embeddings with their dimensions as columns."""
        return self("embeddings").select(
            "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(DIMS)]
        )


SERIES_SQL = """s AS (SELECT event_type, ts, event_id,
  CASE WHEN event_id % 33 = 0 THEN -200.0 ELSE value END AS v FROM events)"""
GAPS_SQL = """s AS (SELECT event_type, ts, event_id,
  CASE WHEN event_id % 33 = 0 OR event_id % 1000 < 60 THEN NULL ELSE value END AS v FROM events)"""
SCORES_SQL = """sc AS (SELECT l.doc_id, d.lang AS model, l.quality AS y,
  d.n_chars::DOUBLE / (d.n_chars + 1000)::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"""
LINE_SCORES_SQL = """sc AS (SELECT l_linestatus AS model, CAST(l_returnflag = 'R' AS INT) AS y,
  l_extendedprice / (l_extendedprice + 30000::DOUBLE) AS p FROM lineitem)"""
FITS_SQL = """f AS (SELECT l_orderkey, l_linenumber, l_returnflag AS model, l_extendedprice AS y,
  l_quantity * 1500::DOUBLE AS pred FROM lineitem)"""
DIMS = 64  # all of an embedding
VECTORS_SQL = "v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(DIMS)) + " FROM embeddings)"
MEANS_SQL = ", ".join(f"avg(e{i}) AS e{i}" for i in range(DIMS))
# Linear gap filling by row position, at most five rows per gap, over a CTE ``s``.
FILL_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM s),
b AS (SELECT *,
  last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS pr,
  first_value(v IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER n AS nr
  FROM o WINDOW p AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                n AS (PARTITION BY event_type ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT event_type, ts, event_id, CASE WHEN v IS NOT NULL THEN v
  WHEN rn - pr <= 5 AND nr IS NOT NULL THEN pv + (nv - pv) * (rn - pr) / (nr - pr)
  WHEN rn - pr <= 5 THEN pv END AS x FROM b)"""


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded without a negative zero, so that engines agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})
