"""Registered queries of the motion operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import media as m
from .functions import pixels as px
from .operators import detect, media, motion, paths, perf, render, select, sequence, trajectory
from .plans.stabilise import export_plan, stabilise, stabilise_xy
from .sources import adapters as a
from .sources import files, plots
from .storage import new_folder

QUERIES: dict = {}
SQL: dict = {}

TRACKS = """tracks as (select user_id as clip_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as frame_idx,
  event_type <> 'error' as delta_valid, value - 50.0 as delta_x, cast(regexp_extract(props, '([0-9]+)', 1) as double) - 50.0 as delta_y,
  event_type = 'signup' as center_valid, value as center_x, cast(regexp_extract(props, '([0-9]+)', 1) as double) as center_y from events)"""
FLOWS = "flows as (select label as frame_idx, vec_id as pt_id, cast(embedding[1] as double) * 10.0 as dx, cast(embedding[2] as double) * 10.0 as dy from embeddings)"
DETS = """dets as (select l_orderkey as frame_idx, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as integer) as det_id,
  l_linenumber % 2 as class_id, l_extendedprice as score, cast(l_partkey % 40 as double) as x1, cast(l_suppkey % 40 as double) as y1,
  cast(l_partkey % 40 as double) + l_quantity as x2, cast(l_suppkey % 40 as double) + l_quantity as y2 from lineitem)"""
PACKETS = """packets as (select user_id as clip_id, case when event_type in ('click', 'view') then 0 else 1 end as stream_rank, event_id as pkt_id,
  cast(event_id * 1000 as bigint) as ts_us, cast(event_id * 1000 + cast(trunc(value * 100) as bigint) as bigint) as dts from events)"""


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _rounded(df, *names: str, places: int = 6):
    """Doubles as both engines write them: rounded, and without negative zero."""
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


def _r(x):
    return F.round(x, 6) + F.lit(0.0)


#: Queries of expressions over one table: name -> (table, key columns, alias -> DuckDB expression).
_SCALARS: dict = {}
_SW, _SH = ('(p_partkey % 3000 + 16)', '((p_size % 50) * 50 + 20)')
def _even(expr: str) -> str:
    scaled = f'cast(floor({expr} * least(1.0::double, 1080.0::double / greatest({_SW}, {_SH})) + 0.5) as bigint)'
    return f'cast(greatest(2, {scaled} - {scaled} % 2) as integer)'
_SCALARS["prj1_proxy_size"] = ("part", ('p_partkey',), {
    "proxy_w": _even(_SW),
    "proxy_h": _even(_SH),
})
_scale = f'least(640.0::double / {_SW}, 640.0::double / {_SH})'
_nw, _nh = (f'cast(floor({_SW} * {_scale} + 0.5) as integer)', f'cast(floor({_SH} * {_scale} + 0.5) as integer)')
_SCALARS["prj2_letterbox"] = ("part", ('p_partkey',), {
    "scale": f'round({_scale}, 6)',
    "new_w": _nw,
    "new_h": _nh,
    "pad_x": f'cast(floor((640 - {_nw}) / 2) as integer)',
    "pad_y": f'cast(floor((640 - {_nh}) / 2) as integer)',
})
_LK = ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity')
_n, _m = ('(l_partkey % 640)', '(l_suppkey % 360)')
_cl = lambda v, top: f'least(greatest({v}, 0.0::double), {top}.0::double)'
_SCALARS["prj4_unletterbox"] = ("lineitem", _LK, {
    "x1": f'round({_cl(f'({_n} - l_quantity) / 0.5', 1279)}, 6)',
    "y1": f'round({_cl(f'({_m} - l_quantity / 2 - 12) / 0.5', 671)}, 6)',
    "x2": f'round({_cl(f'({_n} + l_quantity) / 0.5', 1279)}, 6)',
    "y2": f'round({_cl(f'({_m} + l_quantity / 2 - 12) / 0.5', 671)}, 6)',
})
_SCALARS["prj5_integer_box"] = ("lineitem", _LK, {
    "x": f'cast(greatest(0, floor({_n} - 5.5)) as integer)',
    "y": f'cast(greatest(0, floor({_m} - 5.5)) as integer)',
    "w": f'cast(greatest(0, least(640, ceil({_n} + l_quantity)) - greatest(0, floor({_n} - 5.5))) as integer)',
    "h": f'cast(greatest(0, least(360, ceil({_m} + l_quantity)) - greatest(0, floor({_m} - 5.5))) as integer)',
})
_SCALARS["prj6_8_points"] = ("lineitem", _LK, {
    "center_x": f'round({_n} + l_quantity * 0.5::double, 6)',
    "center_y": f'round({_m} + l_quantity * 0.5::double, 6)',
    "full_x": f'{_n} + 100',
})
_sx = '((value - 50.0) / 10)'
_SCALARS["prj9_13_14_weights"] = ("events", ('event_id',), {
    "sigmoid": f'round(case when {_sx} >= 0 then 1 / (1 + exp(-{_sx})) else exp({_sx}) / (1 + exp({_sx})) end, 6)',
    "weight": f'round(case when {_sx} > 0 then 1 / ({_sx} * {_sx}) else 1 / (1e-3::double * 1e-3::double) end, 3)',
    "huber": 'round(case when value <= 6 then 1.0::double else 6.0::double / value end, 6)',
})
_SCALARS["prj10_11_masks"] = ("embeddings", ('vec_id',), {
    "logit": 'round(list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: cast(p[1] as double) * cast(p[2] as double))), 5) + 0.0::double',
    "bright": 'cast(len(list_filter(embedding, lambda v: v >= 0.1)) as integer)',
    "boxed": 'cast(len(list_filter(embedding[11:14] || embedding[19:22] || embedding[27:30], lambda v: v >= 0.1)) as integer)',
})
_SCALARS["prj12_clamps"] = ("events", ('event_id',), {
    "unit": 'round(least(greatest(value / 60, 0.0::double), 1.0::double), 6)',
    "frame": 'cast(least(greatest(event_id - 100, 0), 4999) as bigint)',
})
_far = 'cast(least(greatest(floor((ceil(value - 50.0) - (value - 50.0)) * 256 + 0.5), 0), 256) as integer)'
_SCALARS["prj15_20_render"] = ("events", ('event_id',), {
    "shift": 'round(-(value - 50.0) * (1920.0::double / 1080), 6) + 0.0::double',
    "w1": _far,
    "w0": f'256 - {_far}',
    "first": 'cast(greatest(0, ceil(value - 50.0)) as integer)',
    "last": 'cast(least(99, floor(value - 50.0 + 63)) as integer)',
    "mixed": f'cast(((200 * (256 - {_far}) + 40 * {_far}) * 256 + 32768) >> 16 as integer)',
})
_sfmt = "(['yuv420p', 'p010', 'yuv420p10', 'bgr24', 'gray', 'odd'])[p_partkey % 6 + 1]"
_splane = "((p_size * p_size * 3 + p_partkey % 5 - 1) // 3)"
_fs = f'least(800.0::double / {_SW}, 600.0::double / {_SH})'
_SCALARS["prj20_31_formats"] = ("part", ('p_partkey',), {
    "frame_bytes": f"cast(case when p_partkey % 7 = 0 then 0 when {_sfmt} in ('yuv420p', 'odd') then cast({_SW} as bigint) * {_SH} * 3 // 2 when {_sfmt} = 'gray' then cast({_SW} as bigint) * {_SH} else cast({_SW} as bigint) * {_SH} * 3 end as bigint)",
    "luma": f"case {_sfmt} when 'p010' then 4096 when 'yuv420p10' then 64 else 16 end",
    "chroma": f"case {_sfmt} when 'p010' then 32768 when 'yuv420p10' then 512 else 128 end",
    "fit_x": f'round((800 - {_SW} * {_fs}) / 2, 6) + 0.0::double',
    "fit_h": f'round({_SH} * {_fs}, 6)',
    "rate": 'round(case when p_size = 0 or p_partkey % 7 = 0 then 0.0::double else p_size * 1000.0::double / (p_partkey % 7) end, 6)',
    "edge": f"cast(case when p_partkey % 2 = 0 and p_size > 0 then p_size when cast(round(sqrt({_splane})) as bigint) * cast(round(sqrt({_splane})) as bigint) = {_splane} then round(sqrt({_splane})) end as integer)",
    "encoder": "case p_partkey % 3 when 0 then 'h264' when 1 then 'hevc' end",
    "copy_w": f'cast(greatest(0, least(p_size - 20 + {_SW}, 1280) - greatest(p_size - 20, 0)) as integer)',
    "copy_h": f'cast(greatest(0, least(p_size - 25 + {_SH}, 720) - greatest(p_size - 25, 0)) as integer)',
})
_SCALARS["src7_8_clip_times"] = ("part", ('p_partkey',), {
    "fps": 'round(cast(coalesce(case when p_partkey % 3 = 0 and p_size > 0 then p_size end, case when p_partkey % 5 = 0 then 25.0 end, case when p_size > 1 and (p_partkey - 1) > 0 then (p_partkey - 1)::double / (p_size - 1) end, 30.0) as double), 6)',
    "time_ns": 'cast(coalesce(case when p_partkey % 7 = 0 then null when p_partkey % 2 = 0 then (p_partkey::hugeint * 2 * 1001 * 1000000000 + 30000) // 60000 when p_partkey % 3 = 0 then ((p_partkey + 1)::hugeint * 2 * 1001 * 1000000000 + 30000) // 60000 end, case when p_partkey % 11 = 0 then 0 else trunc(p_partkey / 25.0::double * 1e9::double) end) as bigint)',
})
_sp = "('/media/' || p_brand || case p_partkey % 3 when 0 then '/clip.MP4' when 1 then '/take.one.mov' else '/raw' end)"
_SCALARS["strf1_6_names"] = ("part", ('p_partkey',), {
    "stem": "case p_partkey % 3 when 0 then 'clip' when 1 then 'take.one' else 'raw' end",
    "parent": "'/media/' || p_brand",
    "named": f"case when lower({_sp}) like '%.mp4' then {_sp} else {_sp} || '.mp4' end",
    "root": "case p_partkey % 3 when 0 then '/' when 1 then '/a' end",
    "export": "coalesce(case when p_partkey % 2 = 0 then p_brand end, 'output') || '_export.mp4'",
    "number": "case when length(p_partkey::varchar) >= 6 then p_partkey::varchar else lpad(p_partkey::varchar, 6, '0') end",
    "bps": 'cast(p_size * 1000000 as bigint)',
    "mbps": 'cast(least(200, greatest(1, floor(p_size * 5000000 / 1048576 + 0.5))) as integer)',
    "kbps": 'cast(case when p_size > 0 then floor(737280 / p_size) - 128 end as bigint)',
    "progress": "'frame ' || p_size || '/64 (' || cast(floor(least(1.0::double, p_size / 64) * 100) as integer) || '%)'",
    "realtime": 'round(1000.0::double / (p_size * 10.0 * 25.0), 6)',
})
_SCALARS["str9_sample_offset"] = ("events", ('event_id',), {
    "samples": 'cast(trunc(cast(trunc((value - 50.0) * 1000) as bigint) * 48000 / 1000000.0) as bigint)',
})


def _scalar_columns() -> dict:
    """The same expressions as Columns: name -> alias -> Column."""
    out: dict = {}
    P, S, Q = (F.col('p_partkey'), F.col('p_size'), F.col('p_retailprice'))
    _W, _H = (P % 3000 + 16, S % 50 * 50 + 20)
    _N, _M = (F.col('l_partkey') % 640, F.col('l_suppkey') % 360)
    _pw, _ph = g.proxy_size(_W, _H)
    out["prj1_proxy_size"] = {
        "proxy_w": _pw,
        "proxy_h": _ph,
    }
    _lb = g.letterbox(_W, _H)
    out["prj2_letterbox"] = {
        "scale": _r(_lb['scale']),
        "new_w": _lb['new_w'],
        "new_h": _lb['new_h'],
        "pad_x": _lb['pad_x'],
        "pad_y": _lb['pad_y'],
    }
    _q = F.col('l_quantity')
    _un = g.unletterbox(_N.cast('double'), _M.cast('double'), _q * 2, _q, F.lit(0.5), F.lit(0), F.lit(12), F.lit(1280), F.lit(672))
    out["prj4_unletterbox"] = {
        "x1": _r(_un['x1']),
        "y1": _r(_un['y1']),
        "x2": _r(_un['x2']),
        "y2": _r(_un['y2']),
    }
    _ib = g.integer_box(_N - 5.5, _M - 5.5, _N + _q, _M + _q, F.lit(640), F.lit(360))
    out["prj5_integer_box"] = {
        "x": _ib['x'],
        "y": _ib['y'],
        "w": _ib['w'],
        "h": _ib['h'],
    }
    out["prj6_8_points"] = {
        "center_x": _r(_N + _q * 0.5),
        "center_y": _r(_M + _q * 0.5),
        "full_x": _N + F.lit(100),
    }
    _x = (F.col('value') - 50.0) / 10
    out["prj9_13_14_weights"] = {
        "sigmoid": _r(g.sigmoid(_x)),
        "weight": F.round(g.sigma_weight(_x), 3),
        "huber": _r(g.huber_weight(F.col('value'))),
    }
    out["prj10_11_masks"] = {
        "logit": F.round(g.dot(F.slice('embedding', 1, 32), F.slice('embedding', 33, 32)), 5) + F.lit(0.0),
        "bright": F.size(F.filter(g.binarise(F.col('embedding'), 0.1), lambda v: v == 255)),
        "boxed": F.size(F.filter(g.crop(g.binarise(F.col('embedding'), 0.1), 8, 2, 1, 4, 3), lambda v: v == 255)),
    }
    _d = F.col('value') - 50.0
    out["prj12_clamps"] = {
        "unit": _r(g.clamp(F.col('value') / 60, 0.0, 1.0)),
        "frame": g.clamp_frame(F.col('event_id') - 100, F.lit(5000)),
    }
    _w1, _w0 = g.blend_weights(_d)
    _s0, _s1 = g.visible_span(_d, F.lit(64), F.lit(100))
    out["prj15_20_render"] = {
        "shift": _r(g.source_shift(_d, F.lit(1920), F.lit(1080))),
        "w1": _w1,
        "w0": _w0,
        "first": _s0,
        "last": _s1,
        "mixed": F.shiftright(g.blend(F.lit(200), F.lit(40), _w0, _w1) * 256 + 32768, 16),
    }
    _fmt = F.element_at(F.array(*map(F.lit, ('yuv420p', 'p010', 'yuv420p10', 'bgr24', 'gray', 'odd'))), (P % 6 + 1).cast('int'))
    _luma, _chroma = g.black_level(_fmt)
    _fit = g.fit_into(_W, _H, F.lit(800), F.lit(600))
    _cr = g.copy_rectangle(S - 20, S - 25, _W, _H, F.lit(1280), F.lit(720))
    out["prj20_31_formats"] = {
        "frame_bytes": g.frame_bytes(_fmt, F.when(P % 7 == 0, -8).otherwise(_W), _H),
        "luma": _luma,
        "chroma": _chroma,
        "fit_x": _r(_fit['x']),
        "fit_h": _r(_fit['h']),
        "rate": _r(g.rational(S * 1000, P % 7)),
        "edge": g.input_edge(F.when(P % 2 == 0, S), S * S * 3 + P % 5 - 1),
        "encoder": g.first_supported(['av1', 'hevc', 'h264'], F.when(P % 3 == 0, F.array(F.lit('h264'))).when(P % 3 == 1, F.array(F.lit('h264'), F.lit('hevc'))).otherwise(F.array(F.lit('vp8')))),
        "copy_w": _cr['w'],
        "copy_h": _cr['h'],
    }
    _fps = m.frame_rate(F.when(P % 3 == 0, S.cast('double')), F.when(P % 5 == 0, F.lit(25.0)), P, (S - 1).cast('double'))
    out["src7_8_clip_times"] = {
        "fps": _r(_fps),
        "time_ns": m.time_ns(F.when(P % 2 == 0, P), F.when(P % 3 == 0, P + 1), F.lit(1001), F.when(P % 7 == 0, 0).otherwise(30000), P, F.when(P % 11 == 0, 0.0).otherwise(25.0)),
    }
    _path = F.concat(F.lit('/media/'), F.col('p_brand'), F.when(P % 3 == 0, '/clip.MP4').when(P % 3 == 1, '/take.one.mov').otherwise('/raw'))
    out["strf1_6_names"] = {
        "stem": m.stem(_path),
        "parent": m.parent(_path),
        "named": m.with_mp4(F.when(P % 4 == 0, F.concat(F.lit("\t "), _path, F.lit(" \n"))).otherwise(_path)),
        "root": m.parent(F.when(P % 3 == 0, F.lit("/a")).when(P % 3 == 1, F.lit("/a/b")).otherwise(F.lit("a"))),
        "export": m.export_name(F.when(P % 2 == 0, F.col('p_brand'))),
        "number": m.padded(P),
        "bps": m.to_bps(S),
        "mbps": m.shown_mbps(S * 5000000),
        "kbps": m.video_kbps(S),
        "progress": m.progress_text(S, F.lit(64)),
        "realtime": _r(m.realtime_factor(S * 10.0, F.lit(25.0))),
    }
    out["str9_sample_offset"] = {
        "samples": m.sample_offset((_d * 1000).cast('long'), F.lit(0)),
    }
    return out


def _scalar(name: str, source: str, keys: tuple[str, ...]):
    return lambda spark, d: a.table(spark, d, source).select(*keys, *(c.alias(n) for n, c in _scalar_columns()[name].items()))


for _name, (_source, _keys, _columns) in _SCALARS.items():
    QUERIES[_name] = _scalar(_name, _source, _keys)
    SQL[_name] = f"select {', '.join(_keys)}, {', '.join(f'{s} as {n}' for n, s in _columns.items())} from {_source}"


@_add("prj7_iou", f"""with {DETS} select p.frame_idx, p.det_id as a, q.det_id as b, round(case when u <= 0 then 0.0::double else i / u end, 6) as iou from (
  select p.frame_idx, p.det_id, q.det_id as other, greatest(0.0::double, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0.0::double, least(p.y2, q.y2) - greatest(p.y1, q.y1)) as i,
    (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - i as u from dets p join dets q on p.frame_idx = q.frame_idx and p.det_id < q.det_id) t
  join dets p on p.frame_idx = t.frame_idx and p.det_id = t.det_id join dets q on q.frame_idx = t.frame_idx and q.det_id = t.other""")
def prj7_iou(spark, d):
    l, r = a.dets(spark, d).alias("l"), a.dets(spark, d).alias("r")  # noqa: E741
    box = lambda t: tuple(F.col(f"{t}.{c}") for c in ("x1", "y1", "x2", "y2"))
    pairs = l.join(r, (F.col("l.frame_idx") == F.col("r.frame_idx")) & (F.col("l.det_id") < F.col("r.det_id")))
    return pairs.select(F.col("l.frame_idx").alias("frame_idx"), F.col("l.det_id").alias("a"), F.col("r.det_id").alias("b"), _r(g.iou(box("l"), box("r"))).alias("iou"))


@_add("agg1_flt1_best_class", "select vec_id, cast(list_position(embedding[1:16], list_max(embedding[1:16])) - 1 as integer) as class_id, round(cast(list_max(embedding[1:16]) as double), 6) as score from embeddings where list_max(embedding[1:16]) >= 0.25")
def agg1(spark, d):
    raw = a.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("class_scores"))
    return detect.best_class(raw).select("vec_id", "class_id", _r(F.col("score").cast("double")).alias("score"))


@_add("prj26_jn8_class_names", "select event_id, coalesce(n_name, 'unknown') as class_name from events left join nation on n_nationkey = event_id % 40")
def class_names(spark, d):
    dim = F.broadcast(a.table(spark, d, "nation").select("n_nationkey", "n_name"))  # 25 rows
    e = a.table(spark, d, "events")
    return e.join(dim, F.col("event_id") % 40 == F.col("n_nationkey"), "left").select("event_id", F.coalesce("n_name", F.lit("unknown")).alias("class_name"))


@_add("prj29_tensor_rows", """with t as (select vec_id, embedding as e, vec_id % 3 = 0 as by_c, unnest(generate_series(0, 9)) as n from embeddings where vec_id % 3 < 2),
  r as (select vec_id, cast(n as integer) as n, list_transform(generate_series(0, 5), lambda c: round(cast(e[1 + case when by_c then c * 10 + n else n * 6 + c end] as double), 6)) as v from t)
  select vec_id, n, v[1] as x, v[2] as y, v[3] as w, v[4] as h, v[5] as score, v[6] as mask from r""")
def tensor_rows(spark, d):
    shape = F.when(F.col("vec_id") % 3 == 0, F.array(*map(F.lit, (1, 6, 10)))).when(F.col("vec_id") % 3 == 1, F.array(*map(F.lit, (1, 10, 6)))).otherwise(F.array(*map(F.lit, (1, 15, 4))))
    flat = a.table(spark, d, "embeddings").select("vec_id", shape.alias("shape"), F.slice("embedding", 1, 60).cast("array<double>").alias("data"))
    rows = detect.tensor_rows(flat, ["vec_id"], mask_dim=1)
    fields = {**{k: F.get("box", F.lit(i)) for i, k in enumerate("xywh")}, "score": F.get("class_scores", F.lit(0)), "mask": F.get("mask_coeff", F.lit(0))}
    return rows.select("vec_id", "n", *(_r(v).alias(k) for k, v in fields.items()))


@_add("prj8_roi_points", """select vec_id, cast(i as integer) as i, round(cast(embedding[2 * i + 1] as double) * 100 + label, 6) as x, round(cast(embedding[2 * i + 2] as double) * 100 + vec_id % 7, 6) as y
  from embeddings, (select unnest(generate_series(0, 7)) as i)""")
def roi_points(spark, d):
    scaled = lambda i: F.get("embedding", i).cast("double") * 100
    points = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(scaled(2 * i).alias("x"), scaled(2 * i + 1).alias("y")))
    moved = a.table(spark, d, "embeddings").select("vec_id", F.posexplode(g.to_frame(points, F.col("label"), F.col("vec_id") % 7)).alias("i", "p"))
    return moved.select("vec_id", "i", _r(F.col("p.x")).alias("x"), _r(F.col("p.y")).alias("y"))


def _resized(image: str, w: str, h: str, to_w: str, to_h: str) -> str:
    """A list resampled between the centres of its cells."""
    place = lambda i, size, to: f"(({i} + 0.5::double) * (cast({size} as double) / {to}) - 0.5::double)"
    cells = lambda i, size, to: (
        f"cast(least(greatest(floor({place(i, size, to)}), 0), {size} - 1) as integer)",
        f"cast(least(least(greatest(floor({place(i, size, to)}), 0), {size} - 1) + 1, {size} - 1) as integer)",
        f"(case when floor({place(i, size, to)}) between 0 and {size} - 2 then {place(i, size, to)} - floor({place(i, size, to)}) else 0.0::double end)",
    )
    (x0, x1, fx), (y0, y1, fy) = cells(f"(i % ({to_w}))", w, to_w), cells(f"(i // ({to_w}))", h, to_h)
    row = lambda y: f"({image}[{y} * {w} + {x0} + 1] * (1 - {fx}) + {image}[{y} * {w} + {x1} + 1] * {fx})"
    return f"list_transform(range(0, ({to_w}) * ({to_h})), lambda i: {row(y0)} * (1 - {fy}) + {row(y1)} * {fy})"


def _part(image: str, width: str, x: str, y: str, w: str, h: str) -> str:
    return f"[{image}[cast(({y} + k // {w}) * {width} + {x} + k % {w} + 1 as integer)] for k in range(0, {w} * {h})]"


#: Masks of 8 x 8 logits for a model input of 16 x 16 cells; sources of 20 x (10 to 14) cells, boxes inside them.
_MASK_H, _MASK_BOX = "(10 + vec_id % 5)", ("(vec_id % 4)", "(vec_id % 3)", "(5 + vec_id % 9)", "(3 + vec_id % 5)")


@_add("prj11_mask_chain", f"""with s as (select vec_id, 20 as src_w, {_MASK_H} as src_h, list_transform(embedding, lambda v: case when v >= 0 then 1 / (1 + exp(-abs(cast(v as double) * 9))) else exp(-abs(cast(v as double) * 9)) / (1 + exp(-abs(cast(v as double) * 9))) end) as share,
    cast(floor({_MASK_H} * 0.8::double + 0.5) as integer) as new_h from embeddings),
  a as (select *, (16 - new_h) // 2 as pad_y, {_resized('share', '8', '8', '16', '16')} as whole from s), b as (select *, {_part('whole', '16', '0', 'pad_y', '16', 'new_h')} as bare from a),
  c as (select *, list_transform({_resized('bare', '16', 'new_h', 'src_w', 'src_h')}, lambda v: case when v >= 0.5 then 255 else 0 end) as bin from b)
  select vec_id, array_to_string({_part('bin', 'src_w', *_MASK_BOX)}, ',') as mask, cast(list_sum(list_transform(bin, lambda v: v // 255)) as bigint) as bright from c""")
def mask_chain(spark, d):
    v = F.col("vec_id")
    src_w, src_h = F.lit(20), (10 + v % 5).cast("int")
    box = g.letterbox(src_w, src_h, 16, 16)
    logits = F.transform("embedding", lambda x: x.cast("double") * 9)
    x, y, w, h = ((v % 4).cast("int"), (v % 3).cast("int"), (5 + v % 9).cast("int"), (3 + v % 5).cast("int"))
    rows = a.table(spark, d, "embeddings").select("vec_id", px.mask(logits, 8, 8, 16, box, src_w, src_h, x, y, w, h).alias("part"), px.mask(logits, 8, 8, 16, box, src_w, src_h, F.lit(0), F.lit(0), src_w, src_h).alias("whole"))
    return rows.select("vec_id", F.array_join("part", ",").alias("mask"), F.size(F.filter("whole", lambda c: c == 255)).cast("long").alias("bright"))


def _blitted(image: str, w: int, h: int, c: int) -> str:
    """A list of 10 x 9 cells of c channels, 16 where the image put at (ax, ay) does not reach."""
    weight = lambda at: f"cast(least(greatest(floor((ceil({at}) - {at}) * 256 + 0.5), 0), 256) as bigint)"
    x, y = f"((i // {c}) % 10)", f"(i // {10 * c})"
    near = lambda v, at, size: f"cast(least(greatest({v} - ceil({at}), 0), {size} - 1) as integer)"
    cell = lambda dy, dx: f"cast({image}[(least({near(y, 'ay', h)} + {dy}, {h - 1}) * {w} + least({near(x, 'ax', w)} + {dx}, {w - 1})) * {c} + i % {c} + 1] as bigint)"
    row = lambda dy: f"({cell(dy, 0)} * (256 - {weight('ax')}) + {cell(dy, 1)} * {weight('ax')})"
    inside = f"{x} >= greatest(0, ceil(ax)) and {x} <= least(9, floor(ax + {w - 1})) and {y} >= greatest(0, ceil(ay)) and {y} <= least(8, floor(ay + {h - 1}))"
    return f"array_to_string(list_transform(range(0, {90 * c}), lambda i: case when {inside} then ({row(0)} * (256 - {weight('ay')}) + {row(1)} * {weight('ay')} + 32768) >> 16 else 16 end), ',')"


@_add("prj19_blit", f"""with p as (select vec_id, (vec_id % 37) / 8.0::double - 2.3::double as ax, (vec_id % 23) / 5.0::double - 1.7::double as ay,
    list_transform(embedding, lambda v: cast(floor((cast(v as double) + 1) * 127) as integer)) as low, list_transform(embedding, lambda v: cast(floor((cast(v as double) + 1) * 511) as integer) * 64) as high from embeddings)
  select vec_id, {_blitted('low', 8, 8, 1)} as luma, {_blitted('high', 8, 8, 1)} as luma_p010, {_blitted('high', 8, 4, 2)} as chroma_p010 from p""")
def blitted(spark, d):
    v = F.col("vec_id")
    at = ((v % 37) / F.lit(8.0) - 2.3, (v % 23) / F.lit(5.0) - 1.7)
    low = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int"))
    high = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 511).cast("int") * 64)
    put = lambda plane, h, c: F.array_join(px.blit(plane, 8, h, F.array_repeat(F.lit(16), 90 * c), 10, 9, *at, channels=c), ",")
    return a.table(spark, d, "embeddings").select("vec_id", put(low, 8, 1).alias("luma"), put(high, 8, 1).alias("luma_p010"), put(high, 4, 2).alias("chroma_p010"))


@_add("flt3_valid_flows", f"with {FLOWS} select frame_idx, pt_id from flows where pt_id % 5 <> 0 and dx + 1 >= 0 and dx + 1 < 2 and dy + 1 >= 0 and dy + 1 < 2")
def flt3(spark, d):
    f = a.flows(spark, d).select("frame_idx", "pt_id", (F.col("pt_id") % 5 != 0).alias("status"), (F.col("dx") + 1).alias("x1"), (F.col("dy") + 1).alias("y1"))
    return motion.valid_flows(f, 2, 2).select("frame_idx", "pt_id")


@_add("flt2_flt4_only_candidate", f"with {DETS} select frame_idx, det_id, score from (select dets.*, count(*) over (partition by frame_idx) as n from dets join nation on n_nationkey = class_id where n_name = (select n_name from nation where n_nationkey = 1)) where n = 1")
def flt4(spark, d):
    names = a.table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"))  # 25 rows
    wanted = names.where("class_id = 1").select("class_name")
    ids = names.join(wanted, "class_name").select("class_id")
    return detect.only_candidate(a.dets(spark, d).join(F.broadcast(ids), "class_id"), ["frame_idx"]).select("frame_idx", "det_id", "score")


@_add("flt6_usable_rois", f"with {DETS} select frame_idx, det_id, cast(greatest(x1 - 20, 0) as integer) as roi_x, cast(greatest(y1 - 20, 0) as integer) as roi_y, cast(least(x1 - 20 + 12, 15) - greatest(x1 - 20, 0) as integer) as roi_w, cast(least(y1 - 20 + 9, 15) - greatest(y1 - 20, 0) as integer) as roi_h from dets where det_id % 3 <> 0 and least(x1 - 20 + 12, 15) > greatest(x1 - 20, 0) and least(y1 - 20 + 9, 15) > greatest(y1 - 20, 0)")
def flt6(spark, d):
    boxes = a.dets(spark, d).select("frame_idx", "det_id", (F.col("x1") - 20).cast("int").alias("box_x"), (F.col("y1") - 20).cast("int").alias("box_y"), F.lit(12).alias("box_w"), F.lit(9).alias("box_h"), (F.col("det_id") % 3 != 0).alias("has_mask"))
    return detect.usable_rois(boxes, 15, 15).select("frame_idx", "det_id", "roi_x", "roi_y", "roi_w", "roi_h")


@_add("flt7_11_frame_filters", f"with {TRACKS} select clip_id, frame_idx from tracks where frame_idx >= 0 and frame_idx < 50 and frame_idx % 5 = 0 and center_valid")
def flt7(spark, d):
    return a.tracks(spark, d).where((F.col("frame_idx") >= 0) & (F.col("frame_idx") < 50) & (F.col("frame_idx") % 5 == 0) & F.col("center_valid")).select("clip_id", "frame_idx")


@_add("src5_seek", f"with {TRACKS} select clip_id, frame_idx, delta_x from tracks where clip_id = 7 and frame_idx = 3")
def seek(spark, d):
    return a.tracks(spark, d, clip_id=7).where("frame_idx = 3").select("clip_id", "frame_idx", "delta_x")


@_add("src5_seek_landed", f"""with {TRACKS}, f as (select * from tracks where frame_idx % 4 <> 3 and frame_idx > 1), c as (select clip_id, max(frame_idx) + 1 as total, min(frame_idx) as head from f group by all),
  w as (select user_id as clip_id, event_id, event_id % 260 - 30 as want from events where event_id % 3 = 0),
  k as (select w.*, cast(greatest(0, least(want, total - 1)) as bigint) as asked, head from w left join c using (clip_id)),
  l as (select k.*, coalesce((select max(f.frame_idx) from f where f.clip_id = k.clip_id and f.frame_idx <= k.asked), head) as landed from k)
  select l.clip_id, event_id, want, asked, landed, round(f.delta_x, 6) + 0.0 as delta_x from l left join f on f.clip_id = l.clip_id and f.frame_idx = l.landed""")
def seek_landed(spark, d):
    frames = a.tracks(spark, d).where("frame_idx % 4 <> 3 and frame_idx > 1").select("clip_id", "frame_idx", "delta_x")
    wanted = a.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("user_id").alias("clip_id"), "event_id", (F.col("event_id") % 260 - 30).alias("want"))
    there = select.seek(wanted, frames.select("clip_id", "frame_idx"), block=16)
    return there.join(frames.withColumnRenamed("frame_idx", "landed"), ["clip_id", "landed"], "left").select("clip_id", "event_id", "want", "asked", "landed", _r(F.col("delta_x")).alias("delta_x"))


_SHOWN = "least(800.0::double / 100, 600.0::double / (60 + event_id % 50))"


@_add("prj22_jn7_clicks", f"""with {DETS}, s as (select event_id as click_id, event_id + 1 as frame_idx, 60 + event_id % 50 as img_h, {_SHOWN} as s, value * 8 as cx, cast(regexp_extract(props, '([0-9]+)', 1) as double) * 6 as cy from events),
  p as (select *, (cx - (800 - 100 * s) / 2) / (100 * s) as nx, (cy - (600 - img_h * s) / 2) / (img_h * s) as ny from s), q as (select click_id, frame_idx, case when nx between 0 and 1 and ny between 0 and 1 then nx * 100 end as x, case when nx between 0 and 1 and ny between 0 and 1 then ny * img_h end as y from p)
  select click_id, q.frame_idx, round(x, 6) as x, round(y, 6) as y, arg_min(det_id, (-score, det_id)) as det_id, count(det_id) as hits
  from q left join dets on dets.frame_idx = q.frame_idx and x between x1 and x2 and y between y1 and y2 group by all""")
def clicks(spark, d):
    e = a.table(spark, d, "events")
    w, h = F.lit(100), 60 + F.col("event_id") % 50
    at = g.clicked(F.col("value") * 8, F.regexp_extract("props", "([0-9]+)", 1).cast("double") * 6, g.fit_into(w, h, F.lit(800.0), F.lit(600.0)))
    made = e.select(F.col("event_id").alias("click_id"), (F.col("event_id") + 1).alias("frame_idx"), (at["x"] * w).alias("x"), (at["y"] * h).alias("y"))
    return _rounded(select.hit_boxes(made, a.dets(spark, d), ["frame_idx"], cell=16), "x", "y")


@_add("agg13_detections", f"with {DETS} select frame_idx, count(*) as n, count(*) filter (class_id = 1) as of_class, count(*) filter (class_id = 1 and score >= 30000) as wanted from dets group by frame_idx")
def detections(spark, d):
    of = F.col("class_id") == 1
    return a.dets(spark, d).groupBy("frame_idx").agg(F.count("*").alias("n"), F.count_if(of).alias("of_class"), F.count_if(of & (F.col("score") >= 30000)).alias("wanted"))


@_add("flt9_with_detection", f"with {DETS} select event_id as frame_idx from events where exists (select 1 from dets where dets.frame_idx = event_id and score >= 30000)")
def with_detection(spark, d):
    seen = a.dets(spark, d).where("score >= 30000").select("frame_idx")
    return a.table(spark, d, "events").select(F.col("event_id").alias("frame_idx")).join(seen, "frame_idx", "left_semi")


def _curve(name: str, value: str) -> str:
    return f"select clip_id, frame_idx, '{name}' as curve, {value} as v from tracks"


@_add("snk3_plot_points", f"""with {TRACKS}, v as ({_curve('object', 'center_x')} union all {_curve('target', "50.0::double")} union all {_curve('delta', 'delta_x')}),
  e as (select clip_id, min(frame_idx) as x0, max(frame_idx) as x1, min(v) as y0, max(v) as y1 from v group by all),
  w as (select clip_id, case when x0 < x1 then x0 else 0 end as x0, case when x0 < x1 then x1 else 1 end as x1, case when y0 < y1 then y0 else 0.0 end as y0, case when y0 < y1 then y1 else 1.0 end as y1 from e)
  select clip_id, curve, frame_idx, round(60 + (frame_idx - x0) / (x1 - x0)::double * 1120, 4) as px, round(40 + (1 - (v - y0) / (y1 - y0)) * 340, 4) as py from v join w using (clip_id)""")
def plotted(spark, d):
    rows = a.tracks(spark, d).withColumn("target", F.lit(50.0))
    return _rounded(plots.plot_points(rows, {"object": "center_x", "target": "target", "delta": "delta_x"}), "px", "py", places=4)


@_add("agg3_jn5_nms", f"""with recursive {DETS}, o as (select *, row_number() over (partition by frame_idx order by score desc, det_id) as r from dets), walk as (
  select frame_idx, r, [det_id] as kept, [{{'c': class_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as boxes from o where r = 1
  union all select o.frame_idx, o.r, case when k then list_append(kept, det_id) else kept end, case when k then list_append(boxes, {{'c': o.class_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) else boxes end
  from (select w.frame_idx, w.kept, w.boxes, o.r, o.det_id, o.class_id, o.x1, o.y1, o.x2, o.y2, len(w.kept) < 100 and len(list_filter(w.boxes, lambda b: b.c = o.class_id and
      (greatest(0.0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0.0, least(b.y2, o.y2) - greatest(b.y1, o.y1))) >
      0.45 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0.0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0.0, least(b.y2, o.y2) - greatest(b.y1, o.y1))))) = 0 as k
    from walk w join o on o.frame_idx = w.frame_idx and o.r = w.r + 1) o)
  select frame_idx, unnest(kept) as det_id from walk w where r = (select max(r) from o where o.frame_idx = w.frame_idx)""")
def nms(spark, d):
    return detect.suppress(a.dets(spark, d), ["frame_idx"]).select("frame_idx", "det_id")


@_add("srt2_nms_top_k", SQL["agg3_jn5_nms"].replace("len(w.kept) < 100", "len(w.kept) < 2"))
def nms_top(spark, d):
    return detect.suppress(a.dets(spark, d), ["frame_idx"], top_k=2).select("frame_idx", "det_id")


@_add("srt3_corners", f"""with recursive {FLOWS}, p as (select frame_idx, pt_id, dx * 5 as x, dy * 5 as y, cast(pt_id % 97 + 1 as double) as response, max(pt_id % 97 + 1) over (partition by frame_idx) as top from flows),
  o as (select *, row_number() over (partition by frame_idx order by response desc, pt_id) as r from p where response >= top * 0.001), walk as (
  select frame_idx, r, [pt_id] as kept, [{{'x': x, 'y': y}}] as pts from o where r = 1
  union all select frame_idx, r, case when k then list_append(kept, pt_id) else kept end, case when k then list_append(pts, {{'x': x, 'y': y}}) else pts end
  from (select w.frame_idx, w.kept, w.pts, o.r, o.pt_id, o.x, o.y, len(w.kept) < 1000 and len(list_filter(w.pts, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) < 4)) = 0 as k
    from walk w join o on o.frame_idx = w.frame_idx and o.r = w.r + 1))
  select frame_idx, unnest(kept) as pt_id from walk w where r = (select max(r) from o where o.frame_idx = w.frame_idx)""")
def corners(spark, d):
    pts = a.flows(spark, d).select("frame_idx", "pt_id", (F.col("dx") * 5).alias("x"), (F.col("dy") * 5).alias("y"), (F.col("pt_id") % 97 + 1).cast("double").alias("response"))
    return detect.spaced_corners(pts, ["frame_idx"]).select("frame_idx", "pt_id")


@_add("jn7_match", f"with {DETS}, again as (select frame_idx, det_id + 100 as det_id, class_id, score, x1 + 0.0006 as x1, y1, x2 + 0.0012 as x2, y2 + case when det_id % 4 = 0 then 1 else 0 end as y2 from dets where det_id % 3 > 0) select l.frame_idx, l.det_id, min(r.det_id) as match_id from dets l left join again r on l.frame_idx = r.frame_idx and l.class_id = r.class_id and abs(l.score - r.score) < 1e-6 and abs(l.x1 - r.x1) < 1e-3 and abs(l.y1 - r.y1) < 1e-3 and abs((l.x2 - l.x1) - (r.x2 - r.x1)) < 1e-3 and abs((l.y2 - l.y1) - (r.y2 - r.y1)) < 1e-3 group by all")
def match(spark, d):
    x = a.dets(spark, d)
    again = x.where("det_id % 3 > 0").withColumns({"x1": F.col("x1") + 0.0006, "x2": F.col("x2") + 0.0012, "y2": F.col("y2") + F.when(F.col("det_id") % 4 == 0, 1).otherwise(0), "det_id": F.col("det_id") + 100})
    return detect.match_within(x, again, ["frame_idx"]).select("frame_idx", "det_id", "match_id")


@_add("jn4_agg2_consensus", f"""with {FLOWS}, s as (select h.frame_idx, h.pt_id as hyp, count(*) as inliers, avg(v.dx) as ax, avg(v.dy) as ay, var_pop(v.dx) + var_pop(v.dy) as noise
  from flows h join flows v on h.frame_idx = v.frame_idx and (v.dx - h.dx) * (v.dx - h.dx) + (v.dy - h.dy) * (v.dy - h.dy) <= 1.0 group by all),
  b as (select *, row_number() over (partition by frame_idx order by inliers desc, hyp) as r from s), n as (select frame_idx, count(*) as n from flows group by all)
  select frame_idx, n, inliers, round(ax, 6) + 0.0 as delta_x, round(ay, 6) + 0.0 as delta_y, round(noise, 6) as noise, n >= 2 and inliers >= 2 as ok from b join n using (frame_idx) where r = 1""")
def consensus(spark, d):
    return _rounded(motion.consensus(a.flows(spark, d), ["frame_idx"]), "delta_x", "delta_y", "noise")


def _selected(spark, d):
    t = a.tracks(spark, d).select("clip_id", "frame_idx", F.col("delta_valid").alias("ok"), F.floor(F.col("center_x") * 10).cast("long").alias("inliers"))
    s = a.tracks(spark, d).where("center_valid").select("clip_id", "frame_idx", F.lit(10).alias("box_x"), F.lit(20).alias("box_y"), F.lit(5).alias("box_w"), F.lit(7).alias("box_h"), (F.col("frame_idx") % 3).alias("n_seeds"))
    return motion.with_selection(t, s, ["clip_id", "frame_idx"])


@_add("str12_jn2_seed_action", f"""with {TRACKS}, t as (select clip_id, frame_idx, delta_valid as ok, cast(floor(center_x * 10) as bigint) as inliers, center_valid, frame_idx % 3 as seeds from tracks)
  select clip_id, frame_idx, ok, inliers, center_valid, case when center_valid then 12.5::double end as center_x, case when center_valid then 23.5::double end as center_y,
  case when center_valid and not (ok and inliers > 0) and seeds > 0 then 'init' when center_valid and ok and inliers > 0 and inliers < 400 and seeds > 0 then 'reinit' when ok and inliers > 0 then 'keep' else 'none' end as seed_action from t""")
def seed_action(spark, d):
    return _selected(spark, d).withColumns({"center_x": F.col("center_x").cast("double"), "center_y": F.col("center_y").cast("double")})


_ANCHOR = """c as (select *, cast(sum(case when delta_valid and frame_idx > 0 then cast(delta_x as decimal(18,6)) else 0 end) over (partition by clip_id order by frame_idx rows unbounded preceding) as double) as c,
  case when center_valid then 1e-16::double else 2.5e-13::double end as w, case when center_valid then center_x else 480.0::double end as m from tracks),
  p as (select clip_id, frame_idx, c + sum(w * (m - c)) over (partition by clip_id) / sum(w) over (partition by clip_id) as position from c)"""


@_add("step1_trajectory", f"with {TRACKS}, {_ANCHOR} select clip_id, frame_idx, round(position, 3) + 0.0 as position, 480.0::double as target, round(least(greatest(position - 480.0, -10000.0::double), 10000.0::double), 3) + 0.0 as delta from p")
def step1(spark, d):
    return _rounded(stabilise(a.tracks(spark, d)), "position", "delta", places=3)


@_add("agg10_total_rms", f"with {TRACKS}, {_ANCHOR} select clip_id, round(sqrt(avg((position - 480.0) * (position - 480.0))), 3) as total_rms from p group by clip_id")
def total_rms(spark, d):
    return _rounded(trajectory.total_rms(stabilise(a.tracks(spark, d)), ["clip_id"], "delta"), "total_rms", places=3)


_ANCHOR_Y = _ANCHOR.replace("delta_x", "delta_y").replace("center_x", "center_y").replace("480.0", "270.0").replace("c as (", "cy as (").replace("from c)", "from cy)").replace("p as (", "py as (")


@_add("step1_trajectory_xy", f"with {TRACKS}, {_ANCHOR}, {_ANCHOR_Y} select clip_id, frame_idx, round(p.position, 3) + 0.0 as x, round(py.position, 3) + 0.0 as y, round(least(greatest(p.position - 480.0, -10000.0::double), 10000.0::double), 3) + 0.0 as delta_x, round(least(greatest(py.position - 270.0, -10000.0::double), 10000.0::double), 3) + 0.0 as delta_y from p join py using (clip_id, frame_idx)")
def step1_xy(spark, d):
    return _rounded(stabilise_xy(a.tracks(spark, d)), "x", "y", "delta_x", "delta_y", places=3)


def _positions(spark, d):
    return trajectory.anchored(trajectory.anchored(a.tracks(spark, d), 480.0, to="x"), 270.0, "delta_y", "center_y", "y")


#: CTEs of step 1 by elimination: rows with weights, then forward (weight and measurement from all frames so far), then back.
def _chain(detected: float, weak: float, step: float, no_step: float) -> str:
    measured = lambda a, c: f"(case when center_valid then center_{a} else {c}::double end - c{a})"
    total = lambda a: f"sum(case when delta_valid then delta_{a} else 0.0 end) over (partition by clip_id order by frame_idx rows unbounded preceding) as c{a}"
    w = f"case when center_valid then 1 / ({detected}::double * {detected}::double) else 1 / ({weak}::double * {weak}::double) end"
    return f"""taken as (select *, {total('x')}, {total('y')} from tracks),
  t as (select clip_id, frame_idx as i, cx, cy, {w} as w, {w} * {measured('x', 480.0)} as hx, {w} * {measured('y', 270.0)} as hy,
    case when delta_valid then 1 / ({step}::double * {step}::double) else 1 / ({no_step}::double * {no_step}::double) end as b, max(frame_idx) over (partition by clip_id) as last from taken),
  forward as (select clip_id, i, last, w as a, hx as gx, hy as gy, b, cx, cy from t where i = 0
    union all select t.clip_id, t.i, t.last, t.w + f.a * t.b / (f.a + t.b), t.hx + f.gx * t.b / (f.a + t.b), t.hy + f.gy * t.b / (f.a + t.b), t.b, t.cx, t.cy from forward f join t on t.clip_id = f.clip_id and t.i = f.i + 1),
  back as (select clip_id, i, gx / a as qx, gy / a as qy, b, cx, cy from forward where i = last
    union all select f.clip_id, f.i, (f.gx + k.b * k.qx) / (f.a + k.b), (f.gy + k.b * k.qy) / (f.a + k.b), f.b, f.cx, f.cy from back k join forward f on f.clip_id = k.clip_id and f.i = k.i - 1)"""


@_add("win1_sigmas", f"with recursive {TRACKS}, {_chain(10.0, 30.0, 1.0, 8.0)} select clip_id, i as frame_idx, round(qx + cx, 4) + 0.0 as x, round(qy + cy, 4) + 0.0 as y from back")
def step1_sigmas(spark, d):
    path, _ = paths.object_path(a.tracks(spark, d), detected=10.0, weak=30.0, step=1.0, no_step=8.0)
    return _rounded(path, "x", "y", places=4)


@_add("win1_robust")
def step1_robust(spark, d):
    return paths.object_path(a.tracks(spark, d), detected=10.0, weak=30.0, step=1.0, no_step=8.0, robust=paths.Robust())[0]


#: CTEs of step 2 by elimination of the five-banded system of p(clip_id, frame_idx, x, y); data sigma 26.5, motion sigma 20 (smoothness 0.5).
_SMOOTH = """n as (select clip_id, frame_idx as i, x, y, count(*) over (partition by clip_id) as n from p),
  bands as (select clip_id, i, n, x / (26.5::double * 26.5) as rx, y / (26.5::double * 26.5) as ry,
    1 / (26.5::double * 26.5) + (cast(i >= 1 as integer) + cast(i <= n - 2 as integer) + cast(i <= n - 3 as integer) + 4 * cast(i >= 1 and i <= n - 2 as integer) + cast(i >= 2 as integer)) / 400.0::double as d0,
    case when i <= n - 2 then -(1 + 2 * (cast(i >= 1 and i <= n - 2 as integer) + cast(i <= n - 3 as integer))) / 400.0::double else 0.0::double end as d1, case when i <= n - 3 then 1 / 400.0::double else 0.0::double end as d2 from n),
  f as (select clip_id, i, n, d0 as piv, 0.0::double as piv1, 0.0::double as one, 0.0::double as two, rx as yx, ry as yy, 0.0::double as yx1, 0.0::double as yy1, d1, d2, 0.0::double as d2b from bands where i = 0
    union all select clip_id, i, n, d0 - two * d2b - across / piv * across, piv, across / piv, two, rx - across / piv * yx - two * yx1, ry - across / piv * yy - two * yy1, yx, yy, d1, d2, d2c
    from (select b.clip_id, b.i, b.n, b.d0, b.rx, b.ry, b.d1, b.d2, f.piv, f.yx, f.yy, f.yx1, f.yy1, f.d2b, f.d2 as d2c, case when b.i >= 2 then f.d2b / f.piv1 else 0.0::double end as two, f.d1 - case when b.i >= 2 then f.d2b * f.one else 0.0::double end as across
      from f join bands b on b.clip_id = f.clip_id and b.i = f.i + 1)),
  g as (select clip_id, i, n, yx / piv as zx, yy / piv as zy, coalesce(lead(one) over w, 0.0::double) as one1, coalesce(lead(two, 2) over w, 0.0::double) as two2 from f window w as (partition by clip_id order by i)),
  s as (select clip_id, i, zx as sx, zy as sy, 0.0::double as sx1, 0.0::double as sy1 from g where i = n - 1
    union all select g.clip_id, g.i, g.zx - g.one1 * s.sx - g.two2 * s.sx1, g.zy - g.one1 * s.sy - g.two2 * s.sy1, s.sx, s.sy from s join g on g.clip_id = s.clip_id and g.i = s.i - 1)"""
_PATH_XY = f"{_ANCHOR.replace('p as (', 'px as (')}, {_ANCHOR_Y}, p as (select clip_id, frame_idx, px.position as x, py.position as y from px join py using (clip_id, frame_idx))"


@_add("step2_smoothed", f"with recursive {TRACKS}, {_PATH_XY}, {_SMOOTH} select clip_id, i as frame_idx, round(sx, 4) + 0.0 as smooth_x, round(sy, 4) + 0.0 as smooth_y from s")
def step2(spark, d):
    return _rounded(paths.smoothed(_positions(spark, d), of=("x", "y")), "smooth_x", "smooth_y", places=4)


@_add("snk2_trajectory_file", f"with {TRACKS}, {_ANCHOR}, {_ANCHOR_Y}, j as (select clip_id, frame_idx, p.position as x, py.position as y from p join py using (clip_id, frame_idx)), k as (select *, least(greatest(x - 480.0, -10000.0::double), 10000.0::double) as dx, least(greatest(y - 270.0, -10000.0::double), 10000.0::double) as dy from j) select clip_id, frame_idx, cast(frame_idx as bigint) * 40000000 as time_ns, round(x, 3) + 0.0 as obj_x, round(y, 3) + 0.0 as obj_y, 480.0::double as target_x, 270.0::double as target_y, round(dx, 3) + 0.0 as delta_x, round(dy, 3) + 0.0 as delta_y, round(sqrt(dx * dx + dy * dy), 3) as delta_norm from k")
def trajectory_file(spark, d):
    rows = stabilise_xy(a.tracks(spark, d)).withColumnsRenamed({"x": "obj_x", "y": "obj_y"})
    rows = rows.withColumns({"time_ns": F.col("frame_idx").cast("long") * 40_000_000, "target_x": F.lit(480.0), "target_y": F.lit(270.0)})
    files.write_trajectory(rows, path := new_folder(spark, "trajectories"))
    return _rounded(files.read_trajectory(spark, path), "obj_x", "obj_y", "delta_x", "delta_y", "delta_norm", places=3)


_LIMITED = "round(least(greatest(p.{0} - s.s{0}, -10000.0::double), 10000.0::double), 3) + 0.0 as delta_{0}"


@_add("step3_smooth_mode", f"with recursive {TRACKS}, {_PATH_XY}, {_SMOOTH} select p.clip_id, p.frame_idx, round(p.x, 3) + 0.0 as x, round(p.y, 3) + 0.0 as y, {_LIMITED.format('x')}, {_LIMITED.format('y')} from p join s on s.clip_id = p.clip_id and s.i = p.frame_idx")
def step3_smooth(spark, d):
    return _rounded(stabilise_xy(a.tracks(spark, d), mode="smooth", robust=False), "x", "y", "delta_x", "delta_y", places=3)


@_add("step2_robust")
def robust(spark, d):
    return paths.smoothed(_positions(spark, d), of=("x", "y"), robust=True)


@_add("agg15_rounds")
def smoothing_rounds(spark, d):
    data, motion = trajectory.smoothing_sigmas(0.5)
    return paths.smooth(_positions(spark, d), motion, motion, data, robust=paths.Robust())[1]


@_add("win2_running_sum", f"with {TRACKS} select clip_id, frame_idx, cast(sum(case when delta_valid then cast(delta_x as decimal(18,6)) else 0 end) over (partition by clip_id order by frame_idx rows unbounded preceding) as double) as path from tracks")
def win2(spark, d):
    return trajectory.accumulated(a.tracks(spark, d)).select("clip_id", "frame_idx", "path")


@_add("win3_around_anchor", f"""with {TRACKS}, s as (select *, cast(sum(case when delta_valid then cast(delta_x as decimal(18,6)) else 0 end) over (partition by clip_id order by frame_idx rows unbounded preceding) as double) as c from tracks),
  f as (select clip_id, arg_min(center_x, frame_idx) as a0, arg_min(c, frame_idx) as fc from s where center_valid group by clip_id) select clip_id, frame_idx, round(a0 + c - fc, 6) + 0.0 as position from s left join f using (clip_id)""")
def win3(spark, d):
    return _rounded(trajectory.around_anchor(a.tracks(spark, d)).select("clip_id", "frame_idx", "position"), "position")


@_add("win4_differences", f"with {TRACKS} select clip_id, frame_idx, round(delta_x - lag(delta_x) over w, 6) + 0.0 as velocity, round(lead(delta_x) over w - 2 * delta_x + lag(delta_x) over w, 6) + 0.0 as acceleration from tracks window w as (partition by clip_id order by frame_idx)")
def win4(spark, d):
    return _rounded(trajectory.differences(a.tracks(spark, d), "delta_x").select("clip_id", "frame_idx", "velocity", "acceleration"), "velocity", "acceleration")


@_add("agg5_6_residuals", f"""with {TRACKS}, o as (select clip_id, abs(delta_x) as x, row_number() over (partition by clip_id order by abs(delta_x)) - 1 as pos, count(*) over (partition by clip_id) as n from tracks)
  select clip_id, count(*) as n, round(avg(x), 4) as mean, round(sqrt(avg(x * x)), 4) as rms, round(max(x), 6) as max, round(max(case when pos = floor(0.95::double * (n - 1)) then x end), 6) as p95 from o group by clip_id""")
def residuals(spark, d):
    rows = a.tracks(spark, d).withColumn("x", F.abs("delta_x"))
    return _rounded(_rounded(trajectory.residual_stats(rows, ["clip_id"], "x"), "max", "p95"), "mean", "rms", places=4)


@_add("agg7_8_perf", "select event_type as provider, count(*) as n, round(avg(value * 0.25::double), 6) as avg_pre_ms, round(avg(value * 0.5::double), 6) as avg_infer_ms, round(avg(value * 0.25::double), 6) as avg_post_ms, round(avg(value), 6) as avg, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99, round(min(value), 6) as min, round(max(value), 6) as max from events group by all")
def perf_summary(spark, d):
    stages = a.DETECT_STAGES
    return _rounded(perf.summary(a.staged_timings(spark, d, stages), stages=tuple(stages)), *(f"avg_{s}" for s in stages), "avg", "p50", "p90", "p99", "min", "max")


def _cumulative(every: int) -> str:
    return f"""with t as (select event_type as provider, event_id as run_id, cast(row_number() over w as integer) as n, avg(cast(value as decimal(18,6))) over u as avg, min(value) over u as min, max(value) over u as max
  from events window w as (partition by event_type order by event_id), u as (partition by event_type order by event_id rows unbounded preceding)) select provider, run_id, n, round(avg, 4) as avg, round(min, 6) as min, round(max, 6) as max from t where n % {every} = 0"""


@_add("win6_cumulative", _cumulative(30))
def win6(spark, d):
    return _rounded(_rounded(perf.cumulative(a.timings(spark, d)), "min", "max"), "avg", places=4)


_MEANS = ", ".join(f"avg(cast(value * {share}::double as decimal(18,6))) over u as avg_{s}" for s, share in a.EXPORT_STAGES.items())


@_add("agg9_export_perf", f"""with t as (select event_type as provider, event_id as run_id, cast(row_number() over w as integer) as n, avg(cast(value as decimal(18,6))) over u as avg, {_MEANS}
  from events window w as (partition by event_type order by event_id), u as (partition by event_type order by event_id rows unbounded preceding))
  select provider, run_id, n, round(avg, 4) as avg, {', '.join(f"round(avg_{s}, 4) as avg_{s}" for s in a.EXPORT_STAGES)}, round(case when avg > 1e-6 then 1000.0::double / avg else 0.0::double end, 4) as fps,
  round(case when avg > 1e-9 then 3110400 * 5.0::double / (avg / 1000.0::double) / 1e9::double else 0.0::double end, 4) as bandwidth_gbs from t where n % 60 = 0""")
def agg9(spark, d):
    stages = a.EXPORT_STAGES
    report = perf.export_report(a.staged_timings(spark, d, stages), tuple(stages), 1920 * 1080 * 3 // 2)
    return _rounded(report, "avg", *(f"avg_{s}" for s in stages), "fps", "bandwidth_gbs", places=4)


@_add("agg11_plot_scale", f"with {TRACKS}, v as (select clip_id, frame_idx, delta_x as v from tracks where frame_idx % 10 not in (3, 4)), r as (select clip_id, min(v) as lo, max(v) as hi from v group by all), s as (select clip_id, case when hi > lo then lo else 0.0::double end as lo, case when hi > lo then hi else 1.0::double end as hi from r) select clip_id, frame_idx, round((v - lo) / (hi - lo), 6) + 0.0 as y from v join s using (clip_id)")
def plot_scale(spark, d):
    odd = F.when(F.col("frame_idx") % 10 == 3, float("nan")).when(F.col("frame_idx") % 10 == 4, float("inf")).otherwise(F.col("delta_x"))
    scaled = trajectory.plot_scaled(a.tracks(spark, d).select("clip_id", "frame_idx", odd.alias("v")), ["clip_id"], "v")
    return scaled.where("frame_idx % 10 not in (3, 4)").select("clip_id", "frame_idx", _r(F.col("y")).alias("y"))


@_add("agg12_13_counts", f"with {TRACKS} select clip_id, count(*) as n, count(*) filter (center_valid) as detector, count(*) filter (not center_valid) as weak_center, count(*) filter (delta_valid) as delta, count(*) filter (not delta_valid) as weak_odometry from tracks group by clip_id")
def counts(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    c, v = F.col("center_valid"), F.col("delta_valid")
    return a.tracks(spark, d).groupBy("clip_id").agg(F.count("*").alias("n"), n(c, "detector"), n(~c, "weak_center"), n(v, "delta"), n(~v, "weak_odometry"))


def _shifts(spark, d):
    t = a.tracks(spark, d)
    clips = t.select("clip_id").distinct().withColumn("num_frames", F.when(F.col("clip_id") % 2 == 0, 120).otherwise(0))
    s = t.where("frame_idx % 3 <> 0").select("clip_id", "frame_idx", F.col("delta_x").alias("dx"), F.col("delta_y").alias("dy"), F.lit(1).alias("nth"))
    earlier = s.where("frame_idx % 3 = 1").select("clip_id", "frame_idx", F.col("dx") - 900, F.col("dy") + 900, F.lit(0))  # overridden by the later ones
    return render.frame_count(clips, t), s.union(earlier)


_SPINE = f"""{TRACKS}, n as (select clip_id, cast(case when clip_id % 2 = 0 then 120 else max(frame_idx) + 1 end as integer) as n from tracks group by clip_id),
  e as (select clip_id, cast(unnest(generate_series(0, n - 1)) as integer) as frame_idx from n),
  s as (select e.clip_id, e.frame_idx, coalesce(delta_x, 0.0::double) as dx, coalesce(delta_y, 0.0::double) as dy from e left join tracks t on t.clip_id = e.clip_id and t.frame_idx = e.frame_idx and t.frame_idx % 3 <> 0)"""
_REACH = "greatest(abs(floor(min({0}))), abs(ceil(max({0}))))"
_CANVAS = f"""c as (select clip_id, cast(2 * {_REACH.format('dx')} + 101 + (2 * {_REACH.format('dx')} + 101) % 2 as integer) as canvas_w, cast(2 * {_REACH.format('dy')} + 100 + (2 * {_REACH.format('dy')} + 100) % 2 as integer) as canvas_h from s group by clip_id),
  v as (select *, cast(floor((canvas_w - 101) / 2) as integer) as origin_x, cast(floor((canvas_h - 100) / 2) as integer) as origin_y from c)"""


@_add("jn3_agg14_spine", f"with {_SPINE} select * from s")
def spine(spark, d):
    return render.spine(*_shifts(spark, d), order="nth")


@_add("agg4_canvas", f"with {_SPINE}, {_CANVAS} select * from v")
def canvas(spark, d):
    return render.canvas(render.spine(*_shifts(spark, d), order="nth"), 101, 100)


@_add("export_plan", f"with {_SPINE}, {_CANVAS} select * from s join v using (clip_id)")
def plan(spark, d):
    return export_plan(*_shifts(spark, d), 101, 100, order="nth")


@_add("jn1_preview", f"with {TRACKS} select t.clip_id, t.frame_idx, t.delta_x, u.delta_y from tracks t join tracks u on t.clip_id = u.clip_id and t.frame_idx = u.frame_idx where u.delta_valid")
def preview(spark, d):
    t = a.tracks(spark, d)
    twice = lambda rows, c: rows.select("clip_id", "frame_idx", c, F.lit(1).alias("nth")).union(rows.where("frame_idx % 2 = 0").select("clip_id", "frame_idx", F.col(c) + 900, F.lit(0)))
    return render.preview(t.select("clip_id", "frame_idx"), twice(t, "delta_x"), twice(t.where("delta_valid"), "delta_y"), order="nth")


@_add("jn1_unmatched", f"with {TRACKS} select clip_id, frame_idx from tracks where not delta_valid")
def unmatched(spark, d):
    t = a.tracks(spark, d).select("clip_id", "frame_idx", "delta_valid")
    return render.unmatched(t.select("clip_id", "frame_idx"), t.where("delta_valid"))


@_add("set2_last_wins", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def last_wins(spark, d):
    return render.last_wins(a.table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


@_add("jn6_lag", f"with {TRACKS} select clip_id, frame_idx, lag(delta_x) over (partition by clip_id order by frame_idx) as before from tracks")
def lagged(spark, d):
    from pyspark.sql import Window

    return a.tracks(spark, d).select("clip_id", "frame_idx", F.lag("delta_x").over(Window.partitionBy("clip_id").orderBy("frame_idx")).alias("before"))


@_add("win7_srt1_rank", f"with {DETS} select frame_idx, det_id, cast(row_number() over (partition by frame_idx order by score desc, det_id) as integer) as rank from dets")
def rank(spark, d):
    from pyspark.sql import Window

    return a.dets(spark, d).select("frame_idx", "det_id", F.row_number().over(Window.partitionBy("frame_idx").orderBy(F.desc("score"), "det_id")).alias("rank"))


@_add("str8_set1_interleave", f"with {PACKETS} select clip_id, pkt_id, stream_rank, cast(row_number() over (partition by clip_id order by ts_us, stream_rank, pkt_id) - 1 as integer) as position from packets")
def interleave(spark, d):
    p = a.packets(spark, d)
    both = media.interleaved(p.where("stream_rank = 0").drop("stream_rank"), p.where("stream_rank = 1").drop("stream_rank"))
    return both.select("clip_id", "pkt_id", "stream_rank", "position")


@_add("agg16_str9_shared_start", f"with {PACKETS} select clip_id, pkt_id, ts_us - min(ts_us) over (partition by clip_id) as ts_us from packets")
def shared_start(spark, d):
    return media.shared_start(a.packets(spark, d)).select("clip_id", "pkt_id", "ts_us")


@_add("win5_monotonic", f"with {PACKETS} select clip_id, pkt_id, max(dts) over (partition by clip_id, stream_rank order by pkt_id rows unbounded preceding) as safe from packets")
def monotonic(spark, d):
    return media.monotonic(a.packets(spark, d)).select("clip_id", "pkt_id", "safe")


@_add("win5_raised_stamps", f"with {PACKETS}, m as (select clip_id, pkt_id, dts, ts_us, max(dts) over (partition by clip_id, stream_rank order by pkt_id rows unbounded preceding) as safe from packets) select clip_id, pkt_id, safe, case when dts < safe then greatest(ts_us, safe) else ts_us end as safe_shown from m")
def raised(spark, d):
    return media.monotonic(a.packets(spark, d), shown="ts_us").select("clip_id", "pkt_id", "safe", "safe_shown")


@_add("str10_chunks", "select clip_id, chunk, count(*) as n, 64 - count(*) as padding from (select user_id as clip_id, cast(floor((row_number() over (partition by user_id order by event_id) - 1) / 64) as integer) as chunk from events) group by all")
def chunked(spark, d):
    return media.chunks(a.table(spark, d, "events").select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("sample_idx")), 64)


@_add("str2_throttle", f"""with recursive {TRACKS}, g as (select clip_id, frame_idx * 7 % 1000 as frame_idx from tracks), f as (select distinct clip_id, cast(frame_idx as integer) as frame_idx from g),
  ok as (select * from f where frame_idx % 3 <> 1),
  w as (select clip_id, min(frame_idx) as frame_idx from ok group by clip_id union all
    select clip_id, frame_idx from (select w.clip_id, (select min(ok.frame_idx) from ok where ok.clip_id = w.clip_id and ok.frame_idx >= w.frame_idx + 15) as frame_idx from w) where frame_idx is not null),
  l as (select f.clip_id, f.frame_idx, max(w.frame_idx) as last from f left join w on w.clip_id = f.clip_id and w.frame_idx < f.frame_idx group by all)
  select clip_id, frame_idx from l where last is null or frame_idx - last >= 15""")
def throttled(spark, d):
    index = (F.col("frame_idx") * 7 % 1000).cast("int")
    return sequence.throttle(a.tracks(spark, d).select("clip_id", index.alias("frame_idx"), (index % 3 != 1).alias("ok")), success="ok")


@_add("str4_5_barrier", f"""with {TRACKS}, p as (select clip_id, frame_idx, frame_idx * 2 as seq from tracks where delta_valid)
  select t.clip_id, t.frame_idx, cast(min(p.seq) as bigint) as passed_at, coalesce(t.frame_idx % 5 > 0 and t.frame_idx * 2 + t.frame_idx % 4 <= min(p.seq), false) as used
  from tracks t left join p on p.clip_id = t.clip_id and p.frame_idx >= t.frame_idx group by t.clip_id, t.frame_idx""")
def barrier(spark, d):
    t = a.tracks(spark, d)
    waited = sequence.barrier(t, t.where("delta_valid").select("clip_id", "frame_idx", (F.col("frame_idx") * 2).alias("seq")))
    return sequence.in_time(waited, t.where("frame_idx % 5 > 0").select("clip_id", "frame_idx", (F.col("frame_idx") * 2 + F.col("frame_idx") % 4).alias("done_at")))


@_add("str3_delay", f"with {TRACKS} select clip_id, frame_idx, coalesce(lead(frame_idx, 30) over (partition by clip_id order by frame_idx), max(frame_idx) over (partition by clip_id)) as emitted_at from tracks")
def delay(spark, d):
    return sequence.delayed(a.tracks(spark, d).select("clip_id", "frame_idx"))


@_add("str6_7_keep_latest", f"with {TRACKS} select clip_id, frame_idx from (select *, row_number() over (partition by clip_id order by frame_idx desc) as r from tracks) where r <= 16")
def keep_latest(spark, d):
    return sequence.keep_latest(a.tracks(spark, d).select("clip_id", "frame_idx"), 16)
