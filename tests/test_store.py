"""Journals and snapshots under replays, failures and two writers; streams whose events arrive out of order."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from turnstream.sources import stores
from turnstream.streaming import events, journal, live, store

EVENT = "job_id long, id long, name string, data string"


def rows(spark, ids, job=1):
    return spark.createDataFrame([(job, i, "a", "{}") for i in ids], EVENT)


def ids(spark, path):
    return sorted(x.id for x in store.read_events(spark, path, EVENT).collect())


def follow(spark, tmp_path, checkpoint="ck"):
    q = store.tail(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/journal", f"{tmp_path}/{checkpoint}")
    q.awaitTermination(120)
    assert q.exception() is None


def test_a_batch_that_runs_again_is_read_once(spark, tmp_path):
    path = f"{tmp_path}/journal"
    for part in ([1, 2], [3], [4, 5]):
        rows(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    follow(spark, tmp_path)
    assert ids(spark, path) == [1, 2, 3, 4, 5]
    assert journal.read_after(store.read_events(spark, path, EVENT), F.lit(3)).count() == 2
    # the driver is lost after the last batch was committed to the folder, before the checkpoint knew
    commits = sorted((f for f in os.listdir(f"{tmp_path}/ck/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{tmp_path}/ck/commits/{f}"):
            os.remove(f"{tmp_path}/ck/commits/{f}")
    follow(spark, tmp_path)
    assert ids(spark, path) == [1, 2, 3, 4, 5]
    # new files go on
    rows(spark, [6]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    follow(spark, tmp_path)
    store.append_events(rows(spark, [7, 8]), path, "once")
    store.append_events(rows(spark, [7, 8]), path, "once")
    store.append_events(rows(spark, []), path)
    assert ids(spark, path) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/journal"
    store.append_events(rows(spark, [1]), path)
    bad = rows(spark, [2, 3]).withColumn("data", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("data"))).repartition(2, "id")
    with pytest.raises(Exception, match="lost"):
        store.append_events(bad, path)
    (tmp_path / "journal" / "lines-of-a-lost-task").write_text(json.dumps({"job_id": 1, "id": 9}) + "\n")
    assert ids(spark, path) == [1]


def test_snapshots_are_replaced_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/snap"
    assert store.read_snapshot(spark, path, EVENT).count() == 0
    assert store.write_snapshot(rows(spark, [1, 2, 3]), path) == 1
    held = store.read_snapshot(spark, path, EVENT)
    bad = rows(spark, [4]).withColumn("data", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        store.write_snapshot(bad, path)
    assert store.read_snapshot(spark, path, EVENT).count() == 3
    assert store.write_snapshot(rows(spark, [5]), path) == 2
    assert held.count() == 3 and [x.id for x in store.read_snapshot(spark, path, EVENT).collect()] == [5]
    assert store.read_snapshot(spark, path, EVENT, 1).count() == 3
    for i in range(3):
        store.write_snapshot(rows(spark, [i]), path)
    store.drop_versions(spark, path, 1)
    assert [x.id for x in store.read_snapshot(spark, path, EVENT).collect()] == [2]
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 2  # the latest, and that of the write that failed


def test_a_file_is_published_once(tmp_path):
    path = f"file:{tmp_path}/a/b"
    assert stores.publish(path, b"one") and not stores.publish(path, b"two")
    assert stores.read_file(path) == b"one" and stores.names(f"file:{tmp_path}/a") == ["b"]


def test_paths_without_a_scheme_are_those_of_spark(spark, tmp_path):
    assert stores.qualified(spark, f"{tmp_path}/x").startswith("file:/")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def shuffled(spark, df, op, tmp_path, parts):
    """op over df as a stream of files whose rows are dealt by the column part."""
    for p in range(parts):
        df.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = op(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").format("parquet").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/out")


def test_events_out_of_order_give_the_result_of_the_batch(spark, rocks, tmp_path):
    r = random.Random(3)
    log = events.log(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("job_id % 10 = 1")
    want = sorted(map(tuple, events.budget_ledger(log).collect()))
    table = log.withColumn("ts", F.timestamp_micros("t")).collect()
    dealt = spark.createDataFrame([(*x, r.randrange(3)) for x in table], f"{log.withColumn('ts', F.timestamp_micros('t'))._jdf.schema().toDDL()}, part int")
    got = shuffled(spark, dealt, lambda s: live.budget_ledger_in_order(s, delay="3650 days"), tmp_path, 3)
    assert len(want) > 50 and sorted(map(tuple, got.select(events.budget_ledger(log).columns).collect())) == want


def test_a_gap_is_given_up_in_time(spark, rocks, tmp_path):
    names = ["running", "queued", "running", "succeeded"]
    rows_ = [(1, 1, names[0], 100, 0), (1, 3, names[2], 110, 0), (1, 4, names[3], 120, 0), (2, 2, names[3], 100, 0), (2, 1, names[0], 110, 1), (9, 1, "running", 9000, 1), (9, 2, "queued", 9999, 2), (9, 3, "running", 99999, 3)]
    df = spark.createDataFrame(rows_, "job_id long, id long, name string, s long, part int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = shuffled(spark, df, lambda s: live.job_states_in_order(s, "1 second", 1_000_000), tmp_path, 4)
    found = sorted((x.job_id, x.id, x.before, x.after, x.accepted) for x in got.where("job_id < 9").collect())
    assert found == [(1, 1, "queued", "running", True), (1, 3, "running", "running", False), (1, 4, "running", "succeeded", True), (2, 1, "queued", "running", True), (2, 2, "running", "succeeded", True)]
