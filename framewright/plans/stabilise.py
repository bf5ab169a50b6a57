"""From tracks to stabilising shifts, and from shifts to an export's canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths, render, trajectory


def stabilise(tracks: DataFrame, centre: float = 480.0, mode: str = "center", smoothness: float = 0.5) -> DataFrame:
    """clip_id, frame_idx, position, target, delta. Mode center holds the object at the image's centre; smooth follows its smoothed path."""
    rows = trajectory.anchored(tracks, centre).select("clip_id", "frame_idx", "position")
    if mode == "smooth":
        rows = rows.join(paths.smoothed(rows, smoothness).withColumnRenamed("smooth_position", "target"), ["clip_id", "frame_idx"])
    else:
        rows = rows.withColumn("target", F.lit(centre))
    return trajectory.shifts(rows, F.col("target"))


def stabilise_xy(tracks: DataFrame, centre: tuple[float, float] = (480.0, 270.0), mode: str = "center", smoothness: float = 0.5, robust: bool = True) -> DataFrame:
    """clip_id, frame_idx, x, y, delta_x, delta_y: both axes; mode smooth follows the path smoothed over both with shared weights."""
    rows = trajectory.anchored(tracks, centre[0], to="x")
    rows = trajectory.anchored(rows, centre[1], "delta_y", "center_y", "y").select("clip_id", "frame_idx", "x", "y")
    if mode == "smooth":
        rows = rows.join(paths.smoothed(rows, smoothness, ("x", "y"), robust), ["clip_id", "frame_idx"])
    else:
        rows = rows.withColumns({"smooth_x": F.lit(centre[0]), "smooth_y": F.lit(centre[1])})
    most = trajectory.MAX_DELTA
    within = lambda a: F.least(F.greatest(F.col(a) - F.col(f"smooth_{a}"), F.lit(-most)), F.lit(most)).alias(f"delta_{a}")
    return rows.select("clip_id", "frame_idx", "x", "y", within("x"), within("y"))


def export_plan(counts: DataFrame, shifts: DataFrame, width: int, height: int, order: str | None = None) -> DataFrame:
    """Every frame with its shift, the last by `order`, and its clip's canvas."""
    every = render.spine(counts, shifts, order)
    return every.join(render.canvas(every, width, height), "clip_id")
