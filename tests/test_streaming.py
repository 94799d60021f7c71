import datetime as dt
import json

from pyspark.sql import functions as F

from gaugeflow.streaming import payload_stream as ps


def doc(hour, value):
    return json.dumps({"hourly": {"time": [f"2024-01-01T{hour:02d}:00"], "temperature_2m": [value]}})


def test_new_files_are_added_exactly_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.json").write_text(doc(1, 1.0) + "\n" + json.dumps({"error": True}) + "\n")
    args = (spark, str(land), ["temperature_2m"], str(tmp_path / "t"), str(tmp_path / "c"))
    assert ps.stream_payloads(*args).count() == 1
    (land / "b.json").write_text(doc(2, 2.0) + "\n")
    out = ps.stream_payloads(*args)
    assert sorted(r["temperature_2m"] for r in out.collect()) == [1.0, 2.0]
    assert ps.stream_payloads(*args).count() == 2  # nothing new, nothing doubled


def test_repeated_polls_keep_one_observation(spark, tmp_path):
    schema = "place string, ts timestamp, v double"
    for n in range(3):
        rows = [("a", dt.datetime(2024, 1, 1, h), float(h)) for h in range(n + 1)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = ps.drain(ps.first_observations(stream, "ts", ["place"], "10 days"), str(tmp_path / "t"), str(tmp_path / "c"))
    assert sorted(r["v"] for r in out.collect()) == [0.0, 1.0, 2.0]


def test_late_polls_are_kept_once_over_batches_and_restarts(spark, tmp_path):
    schema = "place string, ts timestamp, v double"
    land, table, offsets = (str(tmp_path / n) for n in ("in", "t", "c"))

    def poll(*hours, place="a", extra=0.0):
        rows = [(place, None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), h and h + extra) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(land)
        return ps.keep_first(stream, "ts", ["place"], table, offsets)

    poll(100, 101)
    poll(3, 4, 100)  # four days late
    poll(3, 50, 101, None)
    assert sorted(r["v"] or 0 for r in run().collect()) == [0, 3.0, 4.0, 50.0, 100.0, 101.0]
    poll(4, 5, None, extra=0.5)  # seen times keep their first value
    poll(4, place=None)
    want = [0, 3.0, 4.0, 4.0, 5.5, 50.0, 100.0, 101.0]
    assert sorted(r["v"] or 0 for r in run().collect()) == want
    assert sorted(r["v"] or 0 for r in run().collect()) == want  # nothing new
    # the last batch runs again, as after a failure before its commit
    last = max(int(p.name) for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit())
    for p in ("{}", ".{}.crc"):
        (tmp_path / "c" / "commits" / p.format(last)).unlink(missing_ok=True)
    assert sorted(r["v"] or 0 for r in run().collect()) == want


def test_bucket_counts_on_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m),) for m in (0, 2, 3, 9, 59)]
    spark.createDataFrame(rows, "ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    counted = ps.poll_buckets(stream, "ts", 3, delay="1 minute")
    out = ps.drain(counted, str(tmp_path / "t"), str(tmp_path / "c")).orderBy("bucket_start").collect()
    # windows the watermark has not passed stay in state: the last one is still open
    assert [(r["bucket_start"].minute, r["n"]) for r in out] == [(0, 2), (3, 1), (9, 1)]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 7.0), ("b", 2, 1.0)], "k string, t long, v double")
    got = {r["k"]: (r["t"], r["v"]) for r in ps.latest_observation(df, "t", "v", ["k"]).collect()}
    assert got == {"a": (3, 7.0), "b": (2, 1.0)}
    assert ps.poll_buckets(df.select(F.lit("2024-01-01 00:00:30").cast("timestamp").alias("ts")), "ts", 0).first()["n"] == 3
