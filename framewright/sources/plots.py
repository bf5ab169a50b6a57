"""Line plots of clips as SVG files, written as lines of text by Spark's own sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a plot and the room around its axes; the curves' names and colours, fixed.
WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 1200, 420, 60, 20, 40, 40
CURVES = {"object": "#1f77b4", "target": "#ff7f0e", "delta": "#2ca02c"}


def _ends(x: Column) -> tuple[Column, Column]:
    """Least and largest finite value; 0 and 1 where there is none or but one."""
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    low, high = F.min(finite), F.max(finite)
    wide = F.coalesce(low < high, F.lit(False))
    return F.when(wide, low).otherwise(0.0), F.when(wide, high).otherwise(1.0)


def plot_points(rows: DataFrame, curves: dict[str, str]) -> DataFrame:
    """(clip_id, curve, frame_idx, px, py): rows (clip_id, frame_idx, a column for each curve) in the coordinates of the clip's plot.

    Frames run over the width; all curves share the height, by the least and largest of their finite values. Points that are not finite are left out.
    """
    long_ = rows.select("clip_id", "frame_idx", F.explode(F.array(*(F.struct(F.lit(k).alias("curve"), F.col(c).cast("double").alias("v")) for k, c in curves.items()))).alias("p")).select("clip_id", "frame_idx", "p.curve", "p.v")
    (x0, x1), (y0, y1) = _ends(F.col("frame_idx").cast("double")), _ends(F.col("v"))
    ends = long_.groupBy(F.col("clip_id").alias("_clip")).agg(x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"))
    w, h = WIDTH - LEFT - RIGHT, HEIGHT - TOP - BOTTOM
    px = LEFT + (F.col("frame_idx") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * w
    py = TOP + (1 - (F.col("v") - F.col("_y0")) / (F.col("_y1") - F.col("_y0"))) * h
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    return long_.where(finite).join(ends, F.col("clip_id") == F.col("_clip")).select("clip_id", "curve", "frame_idx", px.alias("px"), py.alias("py"))


def plot_lines(rows: DataFrame, curves: dict[str, str], title: str = "clip") -> DataFrame:
    """(clip_id, part, frame_idx, line): the lines of each clip's SVG text, in order of part and frame_idx; a point is a line."""
    names = list(curves)
    points = plot_points(rows, curves)
    nth = F.element_at(F.create_map(*(x for i, k in enumerate(names) for x in (F.lit(k), F.lit(10 + 3 * i)))), F.col("curve"))
    point = F.format_string("%.3f,%.3f", "px", "py")
    heads = [
        (0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}">'), (1, f'<rect x="0" y="0" width="{WIDTH}" height="{HEIGHT}" fill="white" />'),
        (3, f'<line x1="{LEFT}" y1="{TOP}" x2="{LEFT}" y2="{HEIGHT - BOTTOM}" stroke="#333" />'), (4, f'<line x1="{LEFT}" y1="{HEIGHT - BOTTOM}" x2="{WIDTH - RIGHT}" y2="{HEIGHT - BOTTOM}" stroke="#333" />'),
        *((10 + 3 * i - 1, f'<polyline fill="none" stroke="{CURVES.get(k, "#333")}" points="') for i, k in enumerate(names)), *((10 + 3 * i + 1, '" />') for i in range(len(names))),
        *((90 + i, f'<text x="{LEFT + 10}" y="{TOP + 12 + 16 * i}" fill="{CURVES.get(k, "#333")}">{k}</text>') for i, k in enumerate(names)), (99, "</svg>"),
    ]
    clips = rows.select("clip_id").distinct()
    fixed = clips.select("clip_id", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(t).alias("line")) for p, t in heads))).alias("h")).select("clip_id", "h.part", F.lit(0).alias("frame_idx"), "h.line")
    titles = clips.select("clip_id", F.lit(2).alias("part"), F.lit(0).alias("frame_idx"), F.format_string(f'<text x="{LEFT}" y="24" font-size="16">{title} %s</text>', F.col("clip_id").cast("string")).alias("line"))
    return points.select("clip_id", nth.alias("part"), "frame_idx", point.alias("line")).unionByName(fixed).unionByName(titles)


def write_plots(rows: DataFrame, curves: dict[str, str], path: str, title: str = "clip") -> None:
    """One SVG file for each clip below `path`, in a folder clip_id=..., by Spark's commit protocol: a failed run leaves the earlier files."""
    lines = plot_lines(rows, curves, title).repartition("clip_id").sortWithinPartitions("clip_id", "part", "frame_idx")
    lines.select("clip_id", F.col("line").alias("value")).write.partitionBy("clip_id").mode("overwrite").text(path)


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, svg) of written plots."""
    return spark.read.text(path, wholetext=True).select("clip_id", F.col("value").alias("svg"))
