"""Translation consensus of a frame's flow vectors, and the tracking state that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INLIER_PX, LEAST_POINTS, LEAST_RATIO, RESEED = 1.0, 2, 0.0, 400


def valid_flows(flows: DataFrame, width, height) -> DataFrame:
    """Flows with status whose end lies in the image."""
    return flows.where(F.col("status") & (F.col("x1") >= 0) & (F.col("x1") < width) & (F.col("y1") >= 0) & (F.col("y1") < height))


def consensus(flows: DataFrame, keys: list[str], inlier_px: float = INLIER_PX, least: int = LEAST_POINTS, ratio: float = LEAST_RATIO) -> DataFrame:
    """Per group of flows (pt_id, dx, dy): n, inliers, delta_x, delta_y, noise, ok.

    Every vector is a hypothesis; the one with most vectors within inlier_px wins, of equals that with the least pt_id.
    Delta is the mean of its inliers, noise the population variance of both axes. Pairs are looked for in
    the 3 x 3 cells around a vector, cells being inlier_px wide, so that far vectors never meet.
    """
    cell = lambda c, d=0: (F.floor(F.col(c) / inlier_px) + d).cast("long")
    points = flows.select(*keys, "pt_id", "dx", "dy")
    near = [F.struct(cell("dx", i).alias("cx"), cell("dy", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    h = points.withColumn("c", F.explode(F.array(*near))).select(*keys, F.col("pt_id").alias("hyp"), F.col("dx").alias("hx"), F.col("dy").alias("hy"), "c.cx", "c.cy")
    v = points.withColumn("cx", cell("dx")).withColumn("cy", cell("dy"))
    hits = h.join(v, [*keys, "cx", "cy"]).where(F.pow(F.col("dx") - F.col("hx"), 2) + F.pow(F.col("dy") - F.col("hy"), 2) <= inlier_px * inlier_px)
    scored = hits.groupBy(*keys, "hyp").agg(
        F.count("*").alias("inliers"), F.avg("dx").alias("delta_x"), F.avg("dy").alias("delta_y"), (F.var_pop("dx") + F.var_pop("dy")).alias("noise")
    )
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("inliers"), "hyp"))
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"))
    won = scored.withColumn("_r", best).where("_r = 1").drop("_r", "hyp").join(sizes, keys)
    ok = (F.col("n") >= least) & (F.col("inliers") >= least) & (F.col("inliers") >= ratio * F.col("n"))
    return won.select(*keys, "n", "inliers", "delta_x", "delta_y", "noise", ok.alias("ok"))


def seed_action(ok, inliers, selected, seeds, reseed: int = RESEED):
    """init: seeds start the points; reinit: too few were left; keep: the inliers go on; none: nothing to go on with."""
    some = ok & (inliers > 0)
    return (
        F.when(selected & ~some & (seeds > 0), "init").when(selected & some & (inliers < reseed) & (seeds > 0), "reinit").when(some, "keep").otherwise("none")
    )


def with_selection(tracks: DataFrame, selections: DataFrame, keys: list[str]) -> DataFrame:
    """tracks left-joined with the frame's selection (box_x, box_y, box_w, box_h, n_seeds): centre, validity, seed action."""
    joined = tracks.join(selections, keys, "left")
    chosen = F.col("box_x").isNotNull()
    seeds = F.coalesce("n_seeds", F.lit(0))
    return joined.select(
        *tracks.columns, chosen.alias("center_valid"), (F.col("box_x") + F.col("box_w") * 0.5).alias("center_x"), (F.col("box_y") + F.col("box_h") * 0.5).alias("center_y"),
        seed_action(F.col("ok"), F.col("inliers"), chosen, seeds).alias("seed_action"),
    )
