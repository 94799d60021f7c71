"""Polled payloads as a stream: file source, de-duplication and refresh buckets.

Every function but the sinks maps a streaming frame to a streaming frame, so the same
code runs on a bounded table.  State is bounded by the watermark; ``keep_first`` has no state
but its table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.sources.payloads import hourly_payload_to_rows, payload_error


def read_payload_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """One JSON document per line as new files land; rejected documents are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.withColumnRenamed("value", "payload").filter(payload_error("payload").isNull())


def stream_payloads(
    spark: SparkSession, folder: str, variables: Sequence[str], table: str, checkpoint: str
) -> DataFrame:
    """Drain the landed files into a Parquet table, exactly once, and return that table."""
    rows = hourly_payload_to_rows(read_payload_stream(spark, folder), "payload", variables)
    return drain(rows, table, checkpoint)


def drain(rows: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now; offsets live in ``checkpoint``."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(table)


def first_observations(rows: DataFrame, ts_col: str, key_cols: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a (keys, time) observation that repeated polls deliver."""
    return rows.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([*key_cols, ts_col])


def keep_first(rows: DataFrame, ts_col: str, key_cols: Sequence[str], table: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available now into a table with one row per (keys, time), however
    late or often polls deliver it; return that table.

    A micro-batch adds the observations that no earlier batch has stored: an anti-join with the
    rows of the table in the batch's span of days (times are stored by day). Of repeats within a
    batch the row with the least other columns stays. A batch owns the folder of its number and
    overwrites it, and does not look at its own or later folders: when a batch runs again after a
    failure, it stores the same rows. Rows without time belong to a day of their own.
    """
    spark, keys = rows.sparkSession, [*key_cols, ts_col]
    others = [c for c in rows.columns if c not in keys]
    stored = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if others:
            batch = batch.groupBy(*keys).agg(F.min(F.struct(*others)).alias("__first"))
            batch = batch.select(*keys, *[F.col("__first")[c].alias(c) for c in others])
        else:
            batch = batch.select(*keys).distinct()
        batch = batch.withColumn("day", F.to_date(ts_col)).persist()
        try:
            span = batch.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
            near = F.col("day").isNull() | F.col("day").between(F.lit(span["low"]), F.lit(span["high"]))
            before = session.read.schema(stored).option("basePath", table).parquet(table)
            before = before.filter((F.col("batch") < number) & near)
            same = [batch[c].eqNullSafe(before[c]) for c in keys]
            new = batch.join(before, on=reduce(lambda a, b: a & b, same), how="left_anti")
            new.write.mode("overwrite").partitionBy("day").parquet(f"{table}/batch={number}")
        finally:
            batch.unpersist()

    query = (
        rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stored).option("basePath", table).parquet(table).select(*rows.columns)


def latest_observation(
    df: DataFrame, ts_col: str, value_col: str, key_cols: Sequence[str], tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Newest value per key of a bounded table (map-side combined)."""
    newest = F.struct(ts_col, *tiebreak)
    return df.groupBy(*key_cols).agg(
        F.max(ts_col).alias(ts_col), F.max_by(value_col, newest).alias(value_col)
    )


def poll_buckets(rows: DataFrame, ts_col: str, minutes: int, key_cols: Sequence[str] = (), delay: str | None = None) -> DataFrame:
    """Row count per tumbling refresh bucket; give ``delay`` on a stream."""
    if delay:
        rows = rows.withWatermark(ts_col, delay)
    w = F.window(ts_col, f"{max(1, int(minutes))} minutes")
    counted = rows.groupBy(w.alias("w"), *key_cols).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("bucket_start"), *key_cols, "n")
