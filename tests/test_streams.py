"""Stateful streams give the batch operators' rows, over several batches and a restart."""

from __future__ import annotations

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from framewright.operators import media, sequence
from framewright.streaming import merge

PACKETS = "clip_id long, stream_rank int, ts_us long, pkt_id long"
EVENTS = "clip_id long, kind string, frame_idx long, seq long"


@pytest.fixture
def store(spark):
    merge.with_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-stream-")


def run(spark, schema: str, parts: list, start) -> None:
    """Writes each part as a file and runs the query until it is read: a restart from the checkpoint after every part."""
    source = folder()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        start(spark.readStream.schema(schema).parquet(source)).awaitTermination()


def test_merge_of_packets(store):
    rng = random.Random(4)
    packets = [(c, r, t, 1000 * c + 100 * r + i) for c in (1, 2, 3) for r in (0, 1) for i, t in enumerate(sorted(rng.randrange(60) for _ in range(25)))]
    packets = [p for p in packets if not (p[0] == 3 and p[1] == 1)]  # a clip without audio
    parts = [[p for p in packets if 20 * k <= p[2] < 20 * k + 20] for k in range(3)]
    parts.append([(c, r, None, None) for c in (1, 2, 3) for r in (0, 1)])  # all inputs end
    out, check = folder(), folder()
    run(store, PACKETS, parts, lambda s: merge.merged(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
    got = {(r.clip_id, r.position): (r.pkt_id, r.stream_rank) for r in store.read.parquet(out).collect()}
    df = store.createDataFrame(packets, PACKETS)
    both = media.interleaved(df.where("stream_rank = 0").drop("stream_rank"), df.where("stream_rank = 1").drop("stream_rank"))
    want = {(r.clip_id, r.position): (r.pkt_id, r.stream_rank) for r in both.collect()}
    assert got == want and store.read.parquet(out).count() == len(packets)  # none lost, none twice


def test_a_packet_waits_for_the_other_input(store):
    out, check = folder(), folder()
    run(store, PACKETS, [[(1, 0, 5, 1), (1, 0, 9, 2)], [(1, 1, 5, 3)]], lambda s: merge.merged(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
    assert [(r.pkt_id, r.position) for r in store.read.parquet(out).orderBy("position").collect()] == [(1, 0), (3, 1)]  # packet 2 waits


def test_barrier(store):
    rng = random.Random(6)
    events, seq = [], 0
    for clip in (1, 2):
        frames = [(clip, "frame", i, 10 * i + rng.randrange(10)) for i in range(30)]
        done = [(clip, "processed", i, 10 * i + 25 + rng.randrange(10)) for i in range(30) if rng.random() < 0.7]
        results = [(clip, "result", i, 10 * i + rng.choice((5, 20, 60, 90))) for i in range(0, 30, 2)]
        events += frames + done + results
    parts = [sorted((e for e in events if 100 * k <= e[3] < 100 * k + 100), key=lambda e: e[3]) for k in range(5)]
    frames_path, late_path, check = folder(), folder(), folder()
    run(store, EVENTS, parts, lambda s: merge.write_barrier(s, frames_path, late_path, check))
    df = store.createDataFrame(events, EVENTS)
    of = lambda kind: df.where(F.col("kind") == kind)
    waited = sequence.barrier(of("frame").select("clip_id", "frame_idx"), of("processed"))
    arrived = of("frame").select("clip_id", "frame_idx", F.col("seq").alias("came"))
    waited = waited.join(arrived, ["clip_id", "frame_idx"]).withColumn("passed_at", F.when(F.col("passed_at").isNotNull(), F.greatest("passed_at", "came"))).drop("came")
    want = sequence.in_time(waited, of("result").withColumnRenamed("seq", "done_at").drop("kind")).where("passed_at is not null")
    got = store.read.parquet(frames_path).select("clip_id", "frame_idx", "at", "used")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(got) == rows(want.select("clip_id", "frame_idx", "passed_at", "used"))
    passed = {(r.clip_id, r.frame_idx): r.passed_at for r in want.collect()}
    late = {(c, i, s) for c, k, i, s in events if k == "result" and (c, i) in passed and s > passed[c, i]}
    assert {(r.clip_id, r.frame_idx, r["at"]) for r in store.read.parquet(late_path).collect()} == late
    assert late


def test_patience(store):
    out, check, source = folder(), folder(), folder()
    store.createDataFrame([(1, "frame", 4, 1), (1, "frame", 5, 2)], EVENTS).write.mode("append").parquet(source)
    stream = merge.barrier_stream(store.readStream.schema(EVENTS).parquet(source), patience_ms=1)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        rows, end = set(), time.time() + 60
        while len(rows) < 2 and time.time() < end:
            time.sleep(1)
            rows = {(r.clip_id, r.frame_idx, r["at"], r.used) for r in store.read.schema(stream.schema).parquet(out).collect()}
    finally:
        query.stop()
    assert rows == {(1, 4, None, False), (1, 5, None, False)}


def test_cache_of_the_latest(spark):
    """Updates over three batches end with the batch operator's rows."""
    from framewright.streaming import stateful

    rng = random.Random(9)
    rows = [(c, i) for c in (1, 2) for i in rng.sample(range(100), 40)]
    parts = [rows[k::3] for k in range(3)]
    seen = {}

    def keep(batch, _):
        seen.update({r.clip_id: (r.n, r.oldest, r.newest) for r in batch.collect()})

    check = folder()
    run(spark, "clip_id long, frame_idx int", parts, lambda s: stateful.latest_stream(s, 8).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start())
    kept = sequence.keep_latest(spark.createDataFrame(rows, "clip_id long, frame_idx int"), 8).groupBy("clip_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    assert seen == {r.clip_id: (r.n, r.a, r.b) for r in kept.collect()}
