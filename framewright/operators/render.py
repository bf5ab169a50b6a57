"""Canvas and per-frame shifts of an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_count(clips: DataFrame, rows: DataFrame) -> DataFrame:
    """clip_id, n: the metadata's frame count, else the highest index and one, else 1."""
    seen = rows.groupBy("clip_id").agg(F.max("frame_idx").alias("_m"))
    return clips.join(seen, "clip_id", "left").select("clip_id", F.coalesce(F.when(F.col("num_frames") > 0, F.col("num_frames")), F.col("_m") + 1, F.lit(1)).cast("int").alias("n"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, that which comes last by `order`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def spine(counts: DataFrame, shifts: DataFrame, order: str | None = None) -> DataFrame:
    """Every index 0 .. n - 1 of every clip with its shift (dx, dy), 0 where there is none.

    Of several shifts of a frame the last by `order` counts; without an order a frame has one.
    """
    if order:
        shifts = shifts.groupBy("clip_id", "frame_idx").agg(F.max_by(F.struct("dx", "dy"), order).alias("s")).select("clip_id", "frame_idx", "s.dx", "s.dy")
    every = counts.where("n > 0").select("clip_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_idx"))
    joined = every.join(shifts.select("clip_id", "frame_idx", "dx", "dy"), ["clip_id", "frame_idx"], "left")
    return joined.select("clip_id", "frame_idx", F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"))


def canvas(spined: DataFrame, width: int, height: int) -> DataFrame:
    """Per clip the even canvas that holds the image at every shift, and where the unshifted image lies on it."""
    reach = lambda c: F.greatest(F.abs(F.floor(F.min(c))), F.abs(F.ceil(F.max(c))))
    sized = spined.groupBy("clip_id").agg(reach("dx").alias("rx"), reach("dy").alias("ry"))
    even = lambda c, n: (2 * F.col(c) + n + (2 * F.col(c) + n) % 2).cast("int")
    sized = sized.select("clip_id", even("rx", width).alias("canvas_w"), even("ry", height).alias("canvas_h"))
    middle = lambda c, n: F.floor((F.col(c) - n) / 2).cast("int")
    return sized.select("*", middle("canvas_w", width).alias("origin_x"), middle("canvas_h", height).alias("origin_y"))


def preview(frames: DataFrame, tracks: DataFrame, stable: DataFrame, order: str | None = None) -> DataFrame:
    """frames with their track and shift, by inner joins on (clip_id, frame_idx); of several rows of a frame the last by `order` counts."""
    keys = ["clip_id", "frame_idx"]
    if order:
        tracks, stable = (last_wins(t, keys, order).drop(order) for t in (tracks, stable))
    return frames.join(tracks, keys).join(stable, keys)


def unmatched(frames: DataFrame, stable: DataFrame) -> DataFrame:
    """The frames that lack a shift; a preview of them would be incomplete."""
    return frames.join(stable, ["clip_id", "frame_idx"], "left_anti")
