"""Streaming queries, drained with ``availableNow`` so that their result is a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.catalog.io import weather
from gaugeflow.catalog.registry import query
from gaugeflow.session import scratch_path
from gaugeflow.streaming import payload_stream as ps


def _landed(t) -> str:
    folder = scratch_path(t.spark, "landing")
    weather(t).select("payload").write.text(folder)
    return folder


@query(
    "stream_payloads",
    "SELECT date_trunc('minute', ts) + INTERVAL 1 HOUR * i AS time, CASE i WHEN 0 THEN value WHEN 1 THEN value + 1 END AS temperature_2m "
    "FROM events, range(3) g(i) WHERE event_id % 25 <> 0",
)
def _(t):
    table, checkpoint = scratch_path(t.spark, "rows"), scratch_path(t.spark, "offsets")
    return ps.stream_payloads(t.spark, _landed(t), ["temperature_2m"], table, checkpoint)


@query(
    "latest_observation",
    "SELECT event_type, user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type, user_id",
)
def _(t):
    return ps.latest_observation(t("events"), "ts", "value", ["event_type", "user_id"], ["event_id"])


@query("poll_buckets", "SELECT event_type, time_bucket(INTERVAL 5 MINUTES, ts) AS bucket_start, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return ps.poll_buckets(t("events"), "ts", 5, ["event_type"])


@query("stream_first_observations", "SELECT DISTINCT user_id, event_type, ts, value FROM events")
def _(t):
    # every poll delivers the same readings again, in files that arrive out of order over several batches
    landing = scratch_path(t.spark, "polls")
    seen = t("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    for _ in range(2):
        seen.repartition(3, F.pmod(F.hash("user_id"), F.lit(3))).write.mode("append").parquet(landing)
    rows = t.spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    out = ps.keep_first(rows, "ts", ["user_id", "event_type", "value"], scratch_path(t.spark, "kept"), scratch_path(t.spark, "offsets"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
