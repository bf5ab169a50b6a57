"""Hand-checked cases, properties, and streams that give the batch results."""

from __future__ import annotations

import math
import pathlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import queries
from framewright.functions import geometry as g
from framewright.functions import media as m
from framewright.operators import detect, motion, render, sequence, trajectory
from framewright.sources import files
from framewright.streaming import fanout, stateful


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_sizes_and_offsets(spark):
    lit = F.lit
    w, h = g.proxy_size(lit(1920), lit(1080))
    box = g.letterbox(lit(1920), lit(1080))
    near, far = g.blend_weights(lit(2.25))[::-1]
    got = one(spark, w=w, h=h, **box, near=near, far=far, pad=m.sample_offset(lit(21333), lit(0)), drop=m.sample_offset(lit(-21333), lit(0)))
    assert (got["w"], got["h"]) == (1080, 608)
    assert (got["new_w"], got["new_h"], got["pad_x"], got["pad_y"]) == (640, 360, 0, 140)
    assert (got["far"], got["near"]) == (192, 64)
    assert (got["pad"], got["drop"]) == (1023, -1023)


BOXES = [(0, 1, 0.9, 0, 0, 0, 10, 10), (0, 2, 0.8, 0, 1, 1, 11, 11), (0, 3, 0.75, 1, 1, 1, 11, 11), (0, 4, 0.7, 0, 20, 20, 30, 30)]
CHAIN = [(0, 1, 0.9, 0, 0, 0, 10, 10), (0, 2, 0.8, 0, 3, 0, 13, 10), (0, 3, 0.7, 0, 6, 0, 16, 10)]


@pytest.mark.parametrize(("boxes", "per_class", "kept"), [(BOXES, True, [1, 3, 4]), (BOXES, False, [1, 4]), (CHAIN, True, [1, 3])])
def test_suppression(spark, boxes, per_class, kept):
    df = spark.createDataFrame(boxes, "f int, det_id int, score double, class_id int, x1 int, y1 int, x2 int, y2 int")
    df = df.withColumns({c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")})
    assert sorted(r.det_id for r in detect.suppress(df, ["f"], per_class=per_class).collect()) == kept


def test_consensus(spark):
    rows = [(0, 0, 1.0, 0.0), (0, 1, 1.2, 0.0), (0, 2, 1.1, 0.1), (0, 3, 9.0, 9.0), (1, 0, 0.0, 0.0), (1, 1, 5.0, 5.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 5.0, 5.0), (2, 3, 5.0, 5.0)]
    got = {r.f: r for r in motion.consensus(spark.createDataFrame(rows, "f int, pt_id int, dx double, dy double"), ["f"]).collect()}
    assert got[0].inliers == 3 and got[0].delta_x == pytest.approx(1.1) and got[0].noise == pytest.approx(0.0088889, abs=1e-6)
    assert not got[1].ok
    assert (got[2].delta_x, got[2].delta_y) == (0.0, 0.0)


def test_step1(spark):
    for detected, want in ((False, [-1.333333, -0.333333, 1.666667]), (True, [-2.075585, -1.075585, 0.924415])):
        rows = [(0, i, i > 0, float(i), detected and i == 0, 100.0) for i in range(3)]
        df = spark.createDataFrame(rows, "clip_id long, frame_idx int, delta_valid boolean, delta_x double, center_valid boolean, center_x double")
        out = trajectory.shifts(trajectory.anchored(df, 480.0), F.lit(480.0)).orderBy("frame_idx").collect()
        assert [r.delta for r in out] == pytest.approx(want, abs=1e-5)


def test_ticks_are_rounded_to_the_nearest_nanosecond(spark):
    lit, no = F.lit, F.lit(None).cast("long")
    got = one(spark, up=m.time_ns(lit(1), no, lit(1001), lit(30000), lit(0), lit(25.0)), half=m.time_ns(lit(-1), no, lit(1), lit(2_000_000_000 // 4), lit(0), lit(25.0)), none=m.time_ns(no, no, lit(1), lit(90000), lit(1), lit(30.0)))
    assert got == {"up": 33366667, "half": -2, "none": 33333333}


def test_throttle_waits_for_a_success(spark):
    rows = spark.createDataFrame([(0, i, i not in (0, 3, 20)) for i in (0, 3, 5, 12, 20, 24, 30, 39)], "clip_id long, frame_idx int, ok boolean")
    assert sorted(r.frame_idx for r in sequence.throttle(rows, 15, "ok").collect()) == [0, 3, 5, 20, 24, 39]
    assert sequence.throttle(rows, 0, "ok").count() == 8 and sequence.throttle(rows.limit(0), 15, "ok").count() == 0


def test_last_shift_wins(spark):
    counts = spark.createDataFrame([(0, 3)], "clip_id long, n int")
    shifts = spark.createDataFrame([(0, 1, 5.0, 5.0, 1), (0, 1, 7.0, 8.0, 2), (0, 9, 1.0, 1.0, 3)], "clip_id long, frame_idx int, dx double, dy double, nth int")
    assert sorted(map(tuple, render.spine(counts, shifts, "nth").collect())) == [(0, 0, 0.0, 0.0), (0, 1, 7.0, 8.0), (0, 2, 0.0, 0.0)]


def test_fan_out(spark):
    folder, got = tempfile.mkdtemp(prefix="spark-"), {"a": 0, "b": 0, "end": 0}
    spark.range(20).withColumnRenamed("id", "frame_idx").write.parquet(f"{folder}/in")
    count = lambda name: lambda batch, batch_id: got.__setitem__(name, got[name] + batch.count())
    stream = spark.readStream.schema("frame_idx long").parquet(f"{folder}/in")
    fanout.fan_out(stream, {"a": count("a"), "b": count("b")}, f"{folder}/cp", lambda: got.__setitem__("end", 1))
    assert got == {"a": 20, "b": 20, "end": 1}


def test_media_files(spark):
    from pathlib import Path

    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    for name in ("a.mp4", "b.txt", "c.MKV", "d.mkv"):
        (folder / name).write_bytes(b"12345")
    assert sorted(r.path.rpartition("/")[2] for r in files.media_files(spark, str(folder)).collect()) == ["a.mp4", "d.mkv"]


def test_canvas(spark):
    rows = spark.createDataFrame([(0, 0, -3.2, -3.2), (0, 1, 1.5, 1.5)], "clip_id long, frame_idx int, dx double, dy double")
    assert tuple(render.canvas(rows, 100, 101).first()) == (0, 108, 110, 4, 4)


def test_throttle_batch_and_stream(spark):
    rows = spark.createDataFrame([(0, i) for i in (0, 10, 16, 29, 31, 46)] + [(1, i) for i in range(41)], "clip_id long, frame_idx int")
    batch = sorted(map(tuple, sequence.throttle(rows).collect()))
    assert batch == [(0, 0), (0, 16), (0, 31), (0, 46), (1, 0), (1, 15), (1, 30)]
    folder = tempfile.mkdtemp(prefix="spark-")
    for lo, hi in ((0, 20), (20, 60)):
        rows.where((F.col("frame_idx") >= lo) & (F.col("frame_idx") < hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = stateful.throttle_stream(stream).writeStream.format("memory").queryName("ran").outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("ran").collect())) == batch


def test_trajectory_file(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, 0.0, 0.0, 3.0, 4.0)], "clip_id long, frame_idx int, time_ns long, obj_x double, obj_y double, target_x double, target_y double, delta_x double, delta_y double")
    assert files.write_trajectory(df, tempfile.mkdtemp(prefix="spark-") + "/csv") == 1


@pytest.mark.parametrize("folders", [False, True])
def test_trajectory_files_of_many_clips(spark, folders):
    """All rows come back, odd numbers too; a clip lies in one file in frame order, and without folders files do not grow with the clips."""
    rows = [(c, i, i * 40, i / 3, -1e-7 * i, 480.0, 270.0, float("nan") if i == 2 else 3.0 * i, 4.0 * i) for c in [*range(60), None] for i in range(4 - (c or 0) % 3)]
    schema = "clip_id long, frame_idx int, time_ns long, obj_x double, obj_y double, target_x double, target_y double, delta_x double, delta_y double"
    path = tempfile.mkdtemp(prefix="spark-") + "/csv"
    random.Random(4).shuffle(rows)
    assert files.write_trajectory(spark.createDataFrame(rows, schema), path, *[True] * folders) == len(rows)
    want = {(*r, math.hypot(*r[-2:])) for r in rows}
    assert sorted(map(repr, map(tuple, files.read_trajectory(spark, path).collect()))) == sorted(map(repr, want))
    if not folders:
        parts = [[line.split(",")[:2] for line in p.read_text().splitlines()[1:]] for p in pathlib.Path(path).glob("*.csv")]
        assert 0 < len(parts) <= 4 and sorted(c for p in parts for c in dict(p)) == sorted("" if c is None else str(c) for c in [*range(60), None])
        for p in parts:
            assert p == sorted(p, key=lambda x: (int(x[0] or -1), int(x[1])))


def test_clips_are_dealt_once(spark):
    """Numbering a clip's frames and integrating them share a shuffle."""
    plan = queries.QUERIES["step1_trajectory_xy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tensor_rows(spark):
    data = [float(i) for i in range(12)]
    rows = [(1, [1, 6, 2], data), (2, [1, 2, 6], data), (3, [1, 12, 1], data), (4, [2, 6, 2], data), (5, [1, 6, 2], data[:5]), (6, [12], data), (7, None, data), (8, [1, 6, 2], None), (9, [1, 5, 2], data[:10])]
    found = detect.tensor_rows(spark.createDataFrame(rows, "id long, shape array<int>, data array<double>"), ["id"], 1)
    # [1, 6, 2] is shorter in its second axis, so its six rows hold two channels each: no class. [1, 2, 6] has two channels.
    assert found.count() == 0
    wide = [float(i) for i in range(42)]
    found = detect.tensor_rows(spark.createDataFrame([(1, [1, 6, 7], wide), (2, [1, 7, 6], wide)], "id long, shape array<int>, data array<double>"), ["id"], 1)
    got = {(r.id, r.n): (r.box, r.class_scores, r.mask_coeff) for r in found.collect()}
    assert len(got) == 14
    assert got[1, 2] == ([2.0, 9.0, 16.0, 23.0], [30.0], [37.0])
    assert got[2, 2] == ([12.0, 13.0, 14.0, 15.0], [16.0], [17.0])


def test_statistics_of_timings(spark):
    """Ties, one value, nulls, an outlier, many blocks: percentiles and running means as numpy has them."""
    from framewright.operators import perf

    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=501).round(3).tolist(), "b": [2.5], "c": [1.0] * 40 + [7.0] * 3, "d": [*rng.random(50).tolist(), 1e9], "e": [None, 3.0, 4.0], "f": [None]}
    rows = [(k, i, v) for k, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "provider string, run_id long, total_ms double")
    got = {r.provider: r for r in perf.summary(df).collect()}
    for k, x in groups.items():
        x = [v for v in x if v is not None]
        assert got[k].n == len(groups[k])
        assert [got[k][f"p{p}"] for p in (50, 90, 99)] == (pytest.approx(np.percentile(x, (50, 90, 99)).tolist(), rel=1e-12) if x else [None] * 3)
    for r in perf.cumulative(df, every=7, block=16).collect():
        x = [v for v in groups[r.provider][: r.n] if v is not None]
        assert r.n % 7 == 0 and r.run_id == r.n - 1
        assert (r.avg, r.min, r.max) == (pytest.approx(np.mean(x), abs=1e-5), min(x), max(x))
