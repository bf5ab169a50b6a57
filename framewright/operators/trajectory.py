"""Trajectories of clips: integration, anchoring, deltas and statistics, by (clip_id, frame_idx); paths.py has the least-squares paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights 1 / sigma^2 of an anchor: a detection's and the image centre's.
DETECTED, CENTRE = 1e-16, 2.5e-13
MAX_DELTA = 10_000.0


def _ordered(rows=None):
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    return w.rowsBetween(*rows) if rows else w


def _running():
    return _ordered((Window.unboundedPreceding, 0))


def accumulated(tracks: DataFrame, delta: str = "delta_x") -> DataFrame:
    """Adds `path`, the running sum of the valid deltas; exact sums of decimals with six places."""
    step = F.when(F.col("delta_valid"), F.col(delta)).otherwise(0).cast("decimal(18,6)")
    return tracks.withColumn("path", F.sum(step).over(_running()).cast("double"))


def anchored(tracks: DataFrame, centre: float, delta: str = "delta_x", detected: str = "center_x", to: str = "position") -> DataFrame:
    """Adds `position` (or what `to` names): the integrated deltas of a clip, moved as a whole to its weighted anchors.

    The anchors' weights are so small against the odometry's that the least-squares path is the integrated one; its
    shift is the weighted mean of anchor less path. The first frame's delta does not count.
    """
    first = F.row_number().over(_ordered()) == 1
    step = F.when(F.col("delta_valid") & ~first, F.col(delta)).otherwise(0).cast("decimal(18,6)")
    rows = tracks.withColumn("_c", F.sum(F.when(first, 0).otherwise(step)).over(_running()).cast("double"))
    w = F.when(F.col("center_valid"), DETECTED).otherwise(CENTRE)
    m = F.when(F.col("center_valid"), F.col(detected)).otherwise(centre)
    clip = Window.partitionBy("clip_id")
    shift = F.sum(w * (m - F.col("_c"))).over(clip) / F.sum(w).over(clip)
    return rows.withColumn(to, F.col("_c") + shift).drop("_c")


def around_anchor(tracks: DataFrame, delta: str = "delta_x", detected: str = "center_x") -> DataFrame:
    """Adds `position`: integration forward and backward from a clip's first detection; null without any."""
    rows = accumulated(tracks, delta)
    first = F.min(F.when(F.col("center_valid"), F.struct("frame_idx", F.col(detected).alias("at"), F.col("path").alias("c")))).over(Window.partitionBy("clip_id"))
    return rows.withColumn("_f", first).withColumn("position", F.col("_f.at") + F.col("path") - F.col("_f.c")).drop("_f", "path")


def differences(rows: DataFrame, of: str) -> DataFrame:
    """Adds velocity and acceleration: first and second differences along a clip, null at its ends."""
    w = _ordered()
    x, before, after = F.col(of), F.lag(of).over(w), F.lead(of).over(w)
    return rows.withColumn("velocity", x - before).withColumn("acceleration", after - 2 * x + before)


def shifts(rows: DataFrame, target, position: str = "position", most: float = MAX_DELTA) -> DataFrame:
    """Adds delta = position - target, within +-most."""
    d = F.col(position) - target
    return rows.withColumn("delta", F.least(F.greatest(d, F.lit(-most)), F.lit(most)))


def smoothing_sigmas(s: float) -> tuple[float, float]:
    """(data, motion) for a smoothness of 0 to 1."""
    return max(3 * (1 - s) + 50 * s, 1e-3), max(10 / max(s, 1e-3), 1e-3)


def plot_scaled(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds y: the value scaled to its group's range of finite values, which is 0 to 1 where there is none or but one."""
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    ranges = rows.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    wide = F.coalesce(F.col("_hi") > F.col("_lo"), F.lit(False))
    ranges = ranges.select(*keys, F.when(wide, F.col("_lo")).otherwise(0.0).alias("_lo"), F.when(wide, F.col("_hi")).otherwise(1.0).alias("_hi"))
    return rows.join(ranges, keys).withColumn("y", (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def floor_percentile(rows: DataFrame, keys: list[str], value: str, p: float = 0.95) -> DataFrame:
    """Per group the value at index floor(p (n - 1)) in order, not interpolated."""
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(value)) - 1
    n = F.count("*").over(w)
    return rows.withColumn("_at", at).withColumn("_n", n).where(F.col("_at") == F.floor(p * (F.col("_n") - 1))).select(*keys, F.col(value).alias("p95"))


def residual_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group n, mean, rms, max (what is not finite counts as 0) and the floor-index p95."""
    x = F.when(F.isnan(value) | F.col(value).isNull() | (F.abs(value) == float("inf")), 0.0).otherwise(F.col(value))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(x).alias("max"))
    return stats.join(floor_percentile(rows, keys, value), keys)


def total_rms(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    squares = sum((F.col(v) * F.col(v) for v in values), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(squares)).alias("total_rms"))


