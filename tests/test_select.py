"""Clicks, seeks and plots against plain code; rules of the scalar functions by hand-checked values."""

from __future__ import annotations

import random
import tempfile
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from framewright import queries
from framewright.functions import geometry as g
from framewright.functions import media as m
from framewright.functions import pixels as px
from framewright.operators import select
from framewright.sources import plots


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_clicks_hit_boxes(spark):
    rng = random.Random(3)
    boxes = [(f, i, float(rng.randrange(3)), x, y, x + rng.randrange(300), y + rng.randrange(300)) for f in range(3) for i in range(40) for x, y in [(rng.randrange(500) - 50.0, rng.randrange(500) - 50.0)]]
    boxes.append((0, 99, 9.0, 50.0, 50.0, 40.0, 60.0))  # turned inside out: never hit
    clicks = [(k, rng.randrange(4), float(rng.randrange(600)), float(rng.randrange(600))) for k in range(200)] + [(500, 0, None, 1.0), (501, 0, boxes[0][5], boxes[0][6])]
    want = {}
    for k, f, x, y in clicks:
        hit = sorted((-b[2], b[1]) for b in boxes if x is not None and b[0] == f and b[3] <= x <= b[5] and b[4] <= y <= b[6])
        want[k] = (hit[0][1] if hit else None, len(hit))
    df = spark.createDataFrame(clicks, "click_id int, f int, x double, y double")
    got = select.hit_boxes(df, spark.createDataFrame(boxes, "f int, det_id int, score double, x1 double, y1 double, x2 double, y2 double"), ["f"], cell=37)
    assert {r.click_id: (r.det_id, r.hits) for r in got.collect()} == want


@pytest.mark.parametrize("many, listed", [(128, 10), (30, 10), (30, 0), (0, 1)])
def test_clicks_of_busy_frames(spark, monkeypatch, many, listed):
    """With and without a grid, busy frames broadcast or joined: the same hits; columns beside them stay, clicks without a place or a frame too."""
    monkeypatch.setattr(select, "LISTED", listed)
    rng = random.Random(11)
    boxes = [(f, i, float(rng.randrange(3)), x, y, x + rng.randrange(90), y + rng.randrange(90)) for f, n in ((0, 50), (1, 5), (2, 40)) for i in range(n) for x, y in [(rng.randrange(200) - 50.0, rng.randrange(200) - 50.0)]]
    clicks = [(k, rng.randrange(4), float(rng.randrange(200)), float(rng.randrange(200)), f"n{k}") for k in range(60)] + [(90, 0, None, 1.0, "a"), (91, 1, 1.0, None, "b"), (92, None, 1.0, 1.0, None)]
    want = {}
    for k, f, x, y, n in clicks:
        hit = sorted((-b[2], b[1]) for b in boxes if x is not None and y is not None and b[0] == f and b[3] <= x <= b[5] and b[4] <= y <= b[6])
        want[k] = (f, x, y, n, hit[0][1] if hit else None, len(hit))
    df = spark.createDataFrame(clicks, "click_id int, f int, x double, y double, note string")
    got = select.hit_boxes(df, spark.createDataFrame(boxes, "f int, det_id int, score double, x1 double, y1 double, x2 double, y2 double"), ["f"], 7, many).collect()
    assert len(got) == len(want) and {r.click_id: (r.f, r.x, r.y, r.note, r.det_id, r.hits) for r in got} == want


def test_boxes_are_a_row_each(spark):
    """A box as wide as a billion cells is no billion rows, and numbered boxes are not shuffled again to meet the clicks."""
    clicks = spark.createDataFrame([(1, 0, 5e8, 5.0)], "click_id int, f int, x double, y double")
    wide = spark.createDataFrame([(0, 7, 1.0, 0.0, 0.0, 1e9, 9.0)], "f int, det_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.det_id, r.hits) for r in select.hit_boxes(clicks, wide, ["f"], 1).collect()] == [(7, 1)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["prj22_jn7_clicks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange") == 2 and "Generate" not in plan


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_seek(spark, block):
    rng = random.Random(5)
    frames = {c: sorted(rng.sample(range(5, 200), 30)) for c in (1, 2)} | {3: [7]}
    wanted = [(c, rng.randrange(-20, 260)) for c in (1, 2, 3, 4) for _ in range(60)]
    got = select.seek(spark.createDataFrame(wanted, "clip_id long, want long"), spark.createDataFrame([(c, i) for c, x in frames.items() for i in x], "clip_id long, frame_idx int"), block).collect()
    assert len(got) == len(wanted)
    for r in got:
        if r.clip_id == 4:
            assert r.asked is None and r.landed is None
            continue
        own = frames[r.clip_id]
        assert r.asked == max(0, min(r.want, own[-1]))
        assert r.landed == max((i for i in own if i <= r.asked), default=own[0])


def test_seek_reads_wanted_clips_only(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/frames"
    spark.range(60).selectExpr("id % 6 as clip_id", "cast(id as int) as frame_idx").write.partitionBy("clip_id").parquet(path)
    clips = spark.createDataFrame([(2, "a"), (4, "b")], "clip_id long, name string").where("name = 'a'")
    met = spark.read.parquet(path).join(F.broadcast(clips), "clip_id")
    assert "dynamicpruning" in met._jdf.queryExecution().toString().lower()
    assert {r.clip_id for r in met.collect()} == {2}


def test_plots_are_files_that_hold_the_points(spark):
    rows = [(1, i, float(i * i), 5.0, float("nan") if i == 2 else -float(i)) for i in range(6)] + [(2, 0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "clip_id long, frame_idx int, a double, b double, c double")
    path = tempfile.mkdtemp(prefix="spark-") + "/plots"
    plots.write_plots(df, {"object": "a", "target": "b", "delta": "c"}, path)
    plots.write_plots(df, {"object": "a", "target": "b", "delta": "c"}, path)  # replaces the first
    got = {r.clip_id: ET.fromstring(r.svg) for r in plots.read_plots(spark, path).collect()}
    lines = [[tuple(map(float, p.split(","))) for p in e.get("points").split()] for e in got[1].iter("{http://www.w3.org/2000/svg}polyline")]
    y = lambda v: 40 + (1 - (v + 5) / 30) * 340
    want = [[(60 + i / 5 * 1120, y(r[k])) for i, r in enumerate(rows[:6]) if r[k] == r[k]] for k in (2, 3, 4)]
    assert [len(x) for x in lines] == [6, 6, 5]
    for a, b in zip(lines, want):
        assert [v for p in a for v in p] == pytest.approx([v for p in b for v in p], abs=1e-3)
    assert len(list(got[2].iter("{http://www.w3.org/2000/svg}polyline"))) == 3  # one point, one value: still a plot


def test_rules_by_hand(spark):
    lit = F.lit
    none = lit(None).cast("int")
    size = lambda f, w, h: g.frame_bytes(lit(f), lit(w), lit(h))
    got = one(
        spark, e193=g.input_edge(none, lit(193)), e192=g.input_edge(none, lit(192)), e200=g.input_edge(none, lit(200)), neg=g.input_edge(none, lit(-3)), own=g.input_edge(lit(640), lit(5)),
        odd=size("odd", 4, 3), gray=size("gray", 4, 3), none=size("p010", -4, 3), nv12=size("nv12", 3, 3), yuv=size("yuv420p", 4, 4),
        mp4=m.with_mp4(lit("\tclip.mp4\n")), two=m.with_mp4(lit(" a b ")), root=m.parent(lit("/a")), bare=m.parent(lit("a")), deep=m.parent(lit("/a/b")),
        den0=m.time_ns(lit(5), lit(5), lit(1), lit(0), lit(50), lit(25.0)), fps0=m.time_ns(none, none, lit(1), lit(30), lit(50), lit(0.0)), half=m.time_ns(lit(1), none, lit(1), lit(2_000_000_000), lit(0), lit(25.0)), down=m.time_ns(lit(-1), none, lit(1), lit(2_000_000_000), lit(0), lit(25.0)),
        shift=g.source_shift(lit(2.0), lit(100), lit(0)), scale=g.letterbox(lit(0), lit(10))["scale"], fit=g.fit_into(lit(0), lit(10), lit(5.0), lit(5.0))["w"],
    )
    assert (got["e193"], got["e192"], got["e200"], got["neg"], got["own"]) == (8, 8, None, None, 640)
    assert (got["odd"], got["gray"], got["none"], got["nv12"], got["yuv"]) == (18, 12, 0, 17, 24)
    assert (got["mp4"], got["two"], got["root"], got["bare"], got["deep"]) == ("clip.mp4", "a b.mp4", "/", None, "/a")
    assert (got["den0"], got["fps0"], got["half"], got["down"]) == (2_000_000_000, 0, 1, -1)
    assert (got["shift"], got["scale"], got["fit"]) == (None, None, 0.0)


def test_click_mapping(spark):
    shown = g.fit_into(F.lit(200), F.lit(100), F.lit(400.0), F.lit(400.0))  # drawn at (0, 100), 400 x 200
    at = lambda x, y: g.clicked(F.lit(x), F.lit(y), shown)
    back = g.in_widget(F.lit(50.0), F.lit(25.0), shown, F.lit(200), F.lit(100))
    got = one(spark, x=at(100.0, 150.0)["x"], y=at(100.0, 150.0)["y"], edge=at(400.0, 300.0)["x"], out=at(100.0, 99.0)["x"], bx=back["x"], by=back["y"])
    assert got == {"x": 0.25, "y": 0.25, "edge": 1.0, "out": None, "bx": 100.0, "by": 150.0}


def test_images(spark):
    image = F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0)))
    got = one(spark, same=px.resize(image, 2, 2, 2, 2), wide=px.resize(image, 2, 2, 4, 1), cut=px.cut(image, 2, 2, 1, -5, 9, 6), none=px.cut(image, 2, 2, 0, 0, 0, 0), empty=px.resize(image, 2, 2, 0, 3))
    assert got["same"] == [0.0, 1.0, 2.0, 3.0] and got["wide"] == [1.0, 1.25, 1.75, 2.0]
    assert (got["cut"], got["none"], got["empty"]) == ([1.0], [], [])
    plane, to = F.array(*map(F.lit, (10, 20, 30, 40))), F.array_repeat(F.lit(1), 9)
    got = one(spark, whole=px.blit(plane, 2, 2, to, 3, 3, F.lit(1.0), F.lit(0.0)), half=px.blit(plane, 2, 2, to, 3, 3, F.lit(-0.5), F.lit(0.0)), far=px.blit(plane, 2, 2, to, 3, 3, F.lit(9.0), F.lit(0.0)))
    assert got["whole"] == [1, 10, 20, 1, 30, 40, 1, 1, 1]
    assert got["half"] == [15, 1, 1, 35, 1, 1, 1, 1, 1]
    assert got["far"] == [1] * 9
