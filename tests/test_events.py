"""The event table holds what runs counted."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import functions as F

from framewright.streaming import events


def test_a_batch_run_is_counted_while_it_runs(spark):
    path, out = tempfile.mkdtemp(prefix="spark-") + "/events", tempfile.mkdtemp(prefix="spark-") + "/out"
    for n in (10, 32):
        watch = events.Watch("export", spark.range(n).withColumn("ms", F.col("id") * 2.0), n=F.count("*"), most=F.max("ms"))
        watch.rows.write.mode("overwrite").parquet(out)
        watch.record(path)
    got = {(r.run, r.kind, r.name): (r.n, r.total, r["last"]) for r in events.summary(spark.read.schema(events.EVENTS).parquet(path)).collect()}
    assert got["export", "batch", "n"] == (2, 42.0, 32.0) and got["export", "batch", "most"] == (2, 80.0, 62.0)
    assert got["export", "batch", "seconds"][0] == 2


def test_progress_of_a_stream(spark):
    path, source = tempfile.mkdtemp(prefix="spark-") + "/events", tempfile.mkdtemp(prefix="spark-")
    listener = events.ProgressTable(spark, path)
    spark.streams.addListener(listener)
    try:
        for n in (5, 7):
            spark.range(n).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source).observe("seen", F.count("*").alias("n"))
        query = stream.writeStream.format("noop").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.time() + 30
        while not any(k == "ended" for _, k, _ in listener.held) and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.flush() >= 4 and listener.flush() == 0
    got = {(r.kind, r.name): (r.n, r.total) for r in events.summary(spark.read.schema(events.EVENTS).parquet(path)).collect()}
    assert got["progress", "rows"] == (2, 12.0) and got["progress", "seen.n"] == (2, 12.0) and got["ended", "failed"] == (1, 0.0)
