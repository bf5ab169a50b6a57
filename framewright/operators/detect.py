"""From raw model rows to the selected object of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import copy_rectangle, iou

CONFIDENCE, OVERLAP, TOP_K = 0.25, 0.45, 100


def best_class(raw: DataFrame, scores: str = "class_scores", least: float = CONFIDENCE) -> DataFrame:
    """Adds class_id and score of the highest class score, the first of equal ones; drops rows below `least`."""
    top = F.array_max(scores)
    return raw.withColumn("score", top).where(F.col("score") >= least).withColumn("class_id", (F.array_position(scores, F.col("score")) - 1).cast("int"))


#: A tensor's first axis is taken as the channels if it is no longer than this, nor than the second.
MOST_CHANNELS = 512


def tensor_rows(tensors: DataFrame, keys: list[str], mask_dim: int) -> DataFrame:
    """One row (keys, n, box, class_scores, mask_coeff) per candidate of the flat tensors (keys, shape, data).

    Shapes are [1, C, N] or [1, N, C] with C = 4 + classes + mask_dim. Tensors of another shape, without a class, or whose data
    do not fill their shape give no rows.
    """
    one, first, second = (F.get("shape", F.lit(i)) for i in range(3))
    channels_first = (first <= MOST_CHANNELS) & (second >= first)
    c, n = F.when(channels_first, first).otherwise(second), F.when(channels_first, second).otherwise(first)
    fit = (F.size("shape") == 3) & (one == 1) & (F.size("data") == first * second)
    laid = tensors.where(fit).select(*keys, "data", channels_first.alias("_by_c"), c.cast("int").alias("_c"), n.cast("int").alias("_n")).where((F.col("_c") > 4 + mask_dim) & (F.col("_n") > 0))
    # All candidates of a tensor are cut out before they become rows: the data are not repeated for each.
    some = lambda i, at, size: F.transform(F.slice(F.sequence(F.lit(0), F.col("_c") - 1), at + 1, size), lambda k: F.get("data", F.when(F.col("_by_c"), k * F.col("_n") + i).otherwise(i * F.col("_c") + k)))
    classes = F.col("_c") - 4 - mask_dim
    row = lambda i: F.struct(i.alias("n"), some(i, F.lit(0), F.lit(4)).alias("box"), some(i, F.lit(4), classes).alias("class_scores"), some(i, 4 + classes, F.lit(mask_dim)).alias("mask_coeff"))
    return laid.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), row)))


def suppress(dets: DataFrame, keys: list[str], overlap: float = OVERLAP, top_k: int = TOP_K, per_class: bool = True) -> DataFrame:
    """Greedy non-maximum suppression of the boxes (det_id, class_id, score, x1, y1, x2, y2) of each group of keys.

    By falling score, then det_id: a box is kept unless a kept one, of its class if per_class, overlaps it by more than
    `overlap`; it ends at top_k kept. The boxes of a frame are folded in one row; filter by score before.
    """
    fields = ("x1", "y1", "x2", "y2")
    box = F.struct((-F.col("score")).alias("order"), "det_id", "class_id", "score", *fields)
    groups = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    corners = lambda b: tuple(b[f] for f in fields)

    def step(kept, b):
        hit = F.exists(kept, lambda k: ((k["class_id"] == b["class_id"]) if per_class else F.lit(True)) & (iou(corners(k), corners(b)) > overlap))
        return F.when((F.size(kept) >= top_k) | hit, kept).otherwise(F.concat(kept, F.array(b)))

    kind = groups.schema["boxes"].dataType.simpleString()
    kept = groups.select(*keys, F.explode(F.aggregate("boxes", F.array().cast(kind), step)).alias("b"))
    return kept.select(*keys, "b.det_id", "b.class_id", "b.score", *(f"b.{f}" for f in fields))


def usable_rois(dets: DataFrame, width: int, height: int) -> DataFrame:
    """The detections (box_x, box_y, box_w, box_h, has_mask) whose box meets the image and that have a mask, with the cut box (roi_x, ...)."""
    cut = copy_rectangle(F.col("box_x"), F.col("box_y"), F.col("box_w"), F.col("box_h"), F.lit(width), F.lit(height))
    rois = dets.withColumns({"roi_x": cut["left"], "roi_y": cut["top"], "roi_w": cut["w"], "roi_h": cut["h"]})
    return rois.where(F.col("has_mask") & (F.col("roi_w") > 0) & (F.col("roi_h") > 0))


def only_candidate(dets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the groups that have exactly one."""
    return dets.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def spaced_corners(points: DataFrame, keys: list[str], quality: float = 0.001, spacing: float = 2.0, most: int = 1000) -> DataFrame:
    """The strongest points (pt_id, x, y, response) of a group, each at least `spacing` from the stronger ones kept.

    Responses below quality times the group's highest are dropped.
    """
    strong = points.withColumn("_top", F.max("response").over(Window.partitionBy(*keys))).where(F.col("response") >= F.col("_top") * quality)
    groups = strong.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("response")).alias("order"), "pt_id", "x", "y", "response"))).alias("pts"))

    def step(kept, p):
        close = F.exists(kept, lambda k: F.pow(k["x"] - p["x"], 2) + F.pow(k["y"] - p["y"], 2) < spacing * spacing)
        return F.when((F.size(kept) >= most) | close, kept).otherwise(F.concat(kept, F.array(p)))

    kind = groups.schema["pts"].dataType.simpleString()
    return groups.select(*keys, F.explode(F.aggregate("pts", F.array().cast(kind), step)).alias("p")).select(*keys, "p.pt_id", "p.x", "p.y", "p.response")


def match_within(left: DataFrame, right: DataFrame, keys: list[str], score_eps: float = 1e-6, box_eps: float = 1e-3) -> DataFrame:
    """left with det_id of the first right row (by its det_id) of the same class, and of score, corner and size up to the tolerances."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    near = F.abs(F.col("l.score") - F.col("r.score")) < score_eps
    for f in ("x1", "y1", "x2 - {0}.x1", "y2 - {0}.y1"):
        near = near & (F.abs(F.expr(f"l.{f.format('l')}") - F.expr(f"r.{f.format('r')}")) < box_eps)
    for k in [*keys, "class_id"]:
        near = near & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    found = l.join(r, near).groupBy(*(F.col(f"l.{k}").alias(k) for k in keys), F.col("l.det_id").alias("det_id")).agg(F.min("r.det_id").alias("match_id"))
    return left.join(found, [*keys, "det_id"], "left")
