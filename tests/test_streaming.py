"""Streams in several micro-batches agree with the batch forms or with a direct fold."""

import pytest
from pyspark.sql import functions as F

from turnstream.streaming import events, live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return events.log(spark.read.parquet(f"{SF}/events.parquet")).withColumn("ts", F.timestamp_micros("t")).cache()


def streamed(spark, df, op, tmp_path, mode="append"):
    """op over df as a stream of four files, one each micro-batch, in the order of time."""
    # written one after another: a file source reads files in the order of their age
    cuts = [None, *df.agg(F.percentile(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0], None]
    for lo, hi in zip(cuts, cuts[1:]):
        t = F.unix_micros("ts")
        part = df.where((F.lit(True) if lo is None else t >= lo) & (F.lit(True) if hi is None else t < hi))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = op(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out")


def test_ledger_equals_the_batch_form(spark, log, tmp_path):
    got = streamed(spark, log, live.budget_ledger, tmp_path)
    want = events.budget_ledger(log)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_states_follow_the_table(spark, tmp_path):
    names = ["running", "succeeded", "failed", "queued", "expired", "cancel_requested", "canceled", "running"]
    rows = [(j, i, names[(i * 3 + j) % len(names)], "{}", 1.0, j * 100 + i) for j in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "job_id long, id long, name string, data string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {(r.job_id, r.id): r for r in streamed(spark, df, live.job_states, tmp_path).collect()}
    for j in range(5):
        status = "queued"
        for i in range(12):
            r = got[j, i]
            assert r.before == status and r.accepted == (r.after in live.NEXT.get(status, ()))
            status = r.after if r.accepted else status


def test_one_event_for_each_key(spark, log, tmp_path):
    got = streamed(spark, log, lambda s: live.first_of_key(s, "3650 days"), tmp_path).groupBy("job_id", "name", "data").count()
    want = log.select("job_id", "name", "data").distinct()
    assert got.where("count > 1").isEmpty() and got.count() == want.count()


def test_sessions_end_with_the_watermark(spark, tmp_path):
    at = [0, 60, 3000, 3100, 90000, 200000]
    df = spark.createDataFrame([(1, i, "a", "", 1.0, s) for i, s in enumerate(at)], "job_id long, id long, name string, data string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = streamed(spark, df, live.sessions, tmp_path)
    assert sorted(r.n for r in got.where("first_t < timestamp_seconds(90000)").collect()) == [2, 2]
