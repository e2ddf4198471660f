"""Streams against the same work done at once."""

from pyspark.sql import functions as F

from tagloom.plans.views import Views
from tagloom.streaming import ingest, progress
from tests.conftest import SF
from tests.test_duplicates import SCHEMA, alike, planted


def test_late_events_are_dropped_only_from_a_stream(spark, tmp_path):
    def write(rows):
        df = spark.createDataFrame(rows, "ts string, status string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    out = []

    def run():
        stream = spark.readStream.schema("ts timestamp, status string").parquet(f"{tmp_path}/in")
        q = (progress.throughput(stream, "1 hour", "10 minutes").writeStream.outputMode("update")
             .foreachBatch(lambda df, n: out.extend((r.window_start.hour, r.status, r.n) for r in df.collect()))
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        q.awaitTermination()

    write([("2024-01-01 01:10:00", "success"), ("2024-01-01 05:00:00", "error")])
    run()
    write([("2024-01-01 01:20:00", "success"), ("2024-01-01 04:59:00", "error"), ("2024-01-01 05:30:00", "error")])
    run()
    assert (1, "success", 1) in out and (1, "success", 2) not in out
    assert (4, "error", 1) in out and (5, "error", 2) in out


def test_job_progress(spark):
    rows = [("2024-01-01 00:00:00", 1, 3, 9, "success"), ("2024-01-01 00:01:00", 1, 4, 9, "error"), ("2024-01-01 00:00:30", 2, 1, 5, "processing")]
    df = spark.createDataFrame(rows, "ts string, job long, current long, total long, status string").withColumn("ts", F.to_timestamp("ts"))
    out = {r.job: (r.current, r.total, r.success, r.error, r.processing) for r in progress.job_progress(df).collect()}
    assert out == {1: (4, 9, 1, 1, 0), 2: (1, 5, 0, 0, 1)}


def test_ingest_in_batches(spark, tmp_path):
    rows = planted(31, groups=25)
    work = ingest.Ingest(f"{tmp_path}/groups")
    known, want = [], {}
    for number in range(3):
        part = sorted(rows[number::3])
        work.add(spark.createDataFrame(part, SCHEMA), number)
        fresh = []
        for r in part:
            hits = sorted(k[0] for k in known if alike(k, r, 10, 10, 0.85))
            if hits:
                want[r[0]] = hits[0]
                continue
            inner = [k for k in fresh if alike(k, r, 10, 10, 0.85)]
            want[r[0]] = min(k[0] for k in inner) if inner else r[0]
            if not inner:
                fresh.append(r)
        known += fresh
    work.add(spark.createDataFrame(sorted(rows[2::3]), SCHEMA), 2)  # repeated after a failure
    got = {r.name: r.leader for r in work.members(spark).collect()}
    assert got == want


def test_stream_query_matches_batch(spark):
    from tagloom.plans.catalog import QUERIES

    streamed = {(r.window_start, r.status): r.n for r in QUERIES["stream_job_progress"](spark, SF).collect()}
    events = Views(spark, SF).progress().withColumn("ts", F.col("ts").cast("timestamp"))
    batch = progress.throughput(events).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "status", "n")
    assert streamed == {(r.window_start, r.status): r.n for r in batch.collect()}
