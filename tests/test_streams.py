"""Streams in several micro-batches, with late and repeated rows, against the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from studymill.operators import scheduling
from studymill.streaming import ordered, states

pytest.importorskip("google.protobuf")
END = 1_900_000_000  # a row of another key that moves the watermark past all others


@pytest.fixture(scope="module")
def stated(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    if old is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, path, parts, schema, make, name):
    """The rows that a stream over these parts gives, a file and so a micro-batch each."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).select("*", F.timestamp_seconds("s").alias("at")).drop("s").coalesce(1).write.parquet(f"{path}/in/{k:03d}")
    read = spark.readStream.schema(spark.read.parquet(f"{path}/in/*").schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/*")
    q = make(read).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None and len(q.recentProgress) >= len(parts)
    return spark.table(name)


def test_progress_equals_the_batch(stated, tmp_path):
    rng, rows = random.Random(3), []
    for job in range(12):
        at = 1_700_000_000 + job * 3
        for seq in range(rng.randint(1, 9)):
            rows.append((job, seq, at, min(7, 1 + seq), 10 * seq, " Done " if rng.random() < 0.1 else "x"))
            at += rng.choice([5, 20, 45, 100, 170])
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 55))  # late, but within the delay
    cut = len(order) // 4
    parts = [order[k * cut : (k + 1) * cut] + rng.sample(order[: k * cut + 1], min(3, k * cut + 1)) for k in range(4)] + [order[4 * cut :], [(99, 0, END, 7, 100, "done")]]
    schema = "job_id long, seq long, s long, phase int, pct int, message string"
    got = streamed(stated, str(tmp_path), parts + [[(98, 0, END + 1000, 7, 100, "done")]], schema, ordered.progress_stream, "progressed")
    table = stated.createDataFrame(rows, schema).select("*", F.timestamp_seconds("s").alias("at")).drop("s")
    want = sorted(map(tuple, ordered.progress(table).collect()), key=str)
    assert sorted((tuple(r) for r in got.collect() if r.job_id < 90), key=str) == want
    assert {r[2] for r in want} == {"event", "heartbeat", "timeout"}


def test_schedules_equal_the_fold(stated, tmp_path):
    rng = random.Random(4)
    rows = [(u, q, rng.randint(1, 4), 1_700_000_000 + rng.randint(0, 40) * 3600, 100 * k + u) for k in range(60) for u, q in [(rng.randint(0, 2), rng.randint(0, 3))]]
    order = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 20 * 3600))
    parts = [order[:20], order[20:40] + order[5:9], order[40:], [(9, 9, 3, END, -1)], [(8, 8, 3, END + 1_000_000, -2)]]
    got = streamed(stated, str(tmp_path), parts, "user_id long, question_id long, quality int, s long, id long", ordered.scheduled, "rescheduled")
    last = {}
    for r in got.collect():
        last[r.user_id, r.question_id] = max(last.get((r.user_id, r.question_id), ()), tuple(r)[2:])
    reviews = stated.createDataFrame(rows, "user_id long, question_id long, quality int, reviewed_at long, id long")
    want = {(r.user_id, r.question_id): tuple(r)[2:] for r in scheduling.fold(reviews).collect()}
    assert {k: v for k, v in last.items() if k[0] < 8} == want


def test_idle_schedules_are_forgotten(stated, tmp_path):
    day = 86400
    parts = [[(1, 1, 4, END - 900 * day, 1), (1, 1, 4, END - 899 * day, 2)], [(1, 1, 4, END - 100 * day, 3)], [(9, 9, 3, END, -1)], [(8, 8, 3, END + 9 * day, -2)]]
    got = streamed(stated, str(tmp_path), parts, "user_id long, question_id long, quality int, s long, id long", lambda r: ordered.scheduled(r, idle_ms=400 * day * 1000), "idle")
    assert sorted(r.turns for r in got.collect() if r.user_id == 1) == [1, 1, 2]


def test_both_forms_of_the_step_agree(spark):
    rng = random.Random(5)
    logs = [[rng.randint(1, 4) for _ in range(rng.randint(1, 25))] for _ in range(200)]
    df = spark.createDataFrame([(k, 0, q, at, at) for k, log in enumerate(logs) for at, q in enumerate(log)], "user_id long, question_id long, quality int, reviewed_at long, id long")
    got = {r.user_id: tuple(r)[2:] for r in scheduling.fold(df).collect()}
    for k, log in enumerate(logs):
        now = (0, scheduling.FIRST_INTERVAL, scheduling.FIRST_EASE, 0)
        for q in log:
            now = states.after(now, q)
        assert got[k] == pytest.approx(now)
