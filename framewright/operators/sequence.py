"""Order-dependent selections of frames: throttling, delaying, keeping the latest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded


def ran(index: np.ndarray, ok: np.ndarray, gap: int, last: int | None = None) -> tuple[np.ndarray, int | None]:
    """Which of the rising indices run, and the last success: a frame runs without an earlier success, or `gap` or more after it."""
    out, good, at = np.zeros(len(index), bool), index[ok], 0
    while at < len(index):
        at = at if last is None else max(at, int(np.searchsorted(index, last + gap)))  # frames too soon after the success don't run
        next_good = int(np.searchsorted(good, index[at])) if at < len(index) else len(good)
        end = int(np.searchsorted(index, good[next_good])) + 1 if next_good < len(good) else len(index)
        out[at:end] = True
        last, at = (int(good[next_good]), end) if next_good < len(good) else (last, len(index))
    return out, last


def _successes(gap: int):
    """Of each clip's successes in order those that count: the first, then the next one `gap` or more after the last that did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for clip in batch.column("good"):
                good, at, own = clip.values.to_numpy(), 0, []
                while at < len(good):
                    own.append(good[at])
                    at = int(np.searchsorted(good, good[at] + gap))
                kept.append(own)
            yield pa.record_batch([batch.column("clip_id"), pa.array(kept, pa.list_(pa.int32()))], names=["clip_id", "kept"])

    return run


def throttle(frames: DataFrame, gap: int = 15, success: str | None = None) -> DataFrame:
    """(clip_id, frame_idx) of the frames that run: the first, then each at least `gap` after the last that succeeded.

    `success` names a boolean column; without it every run succeeds. A repeated index counts once, as a success if one of its rows
    is. With a gap of 0 or less every frame runs. Only the successes that count are told clip by clip, from their indices alone, many
    clips in a batch; which frames run follows from them by a window.
    """
    ok = F.max(F.coalesce(F.col(success), F.lit(False))) if success else F.lit(True)
    rows = frames.groupBy("clip_id", F.col("frame_idx").cast("int").alias("frame_idx")).agg(ok.alias("ok"))
    if gap <= 0:
        return rows.select("clip_id", "frame_idx")
    good = rows.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("frame_idx")))).alias("good"))
    kept = bounded(good).mapInArrow(_successes(gap), "clip_id long, kept array<int>").select("clip_id", F.explode("kept").alias("frame_idx"), F.lit(True).alias("_kept"))
    marked = rows.select("clip_id", "frame_idx", F.lit(False).alias("_kept")).unionAll(kept).groupBy("clip_id", "frame_idx").agg(F.max("_kept").alias("_kept"))
    before = Window.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_kept"), F.col("frame_idx"))).over(before)
    return marked.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("frame_idx") - F.col("_last") >= gap)).select("clip_id", "frame_idx")


def barrier(frames: DataFrame, processed: DataFrame) -> DataFrame:
    """frames (clip_id, frame_idx) with `passed_at`: the first event (clip_id, frame_idx, seq) that shows the frame as processed.

    A frame waits until an index as high as its own is processed; null where none ever is.
    """
    both = frames.select("clip_id", "frame_idx", F.lit(None).cast("long").alias("seq"), F.lit(True).alias("_own")).union(
        processed.select("clip_id", "frame_idx", F.col("seq").cast("long"), F.lit(False))
    )
    ahead = Window.partitionBy("clip_id").orderBy("frame_idx").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("passed_at", F.min("seq").over(ahead)).where("_own").select("clip_id", "frame_idx", "passed_at")


def in_time(waited: DataFrame, results: DataFrame) -> DataFrame:
    """barrier's rows with `used`: whether the frame's result (clip_id, frame_idx, done_at) is there when the frame passes.

    The index is published before the result, so a later result is lost and never looked at again; null passed_at uses none.
    """
    done = results.groupBy("clip_id", "frame_idx").agg(F.min("done_at").alias("done_at"))
    return waited.join(done, ["clip_id", "frame_idx"], "left").withColumn("used", F.coalesce(F.col("done_at") <= F.col("passed_at"), F.lit(False))).drop("done_at")


def delayed(frames: DataFrame, by: int = 30) -> DataFrame:
    """Adds `emitted_at`: the index at whose arrival a frame is consumed, that of the clip's end for the last ones."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    last = F.max("frame_idx").over(Window.partitionBy("clip_id"))
    return frames.withColumn("emitted_at", F.coalesce(F.lead("frame_idx", by).over(w), last))


def keep_latest(rows: DataFrame, cap: int, by: str = "clip_id", order: str = "frame_idx") -> DataFrame:
    """The latest `cap` rows of a group: a bounded queue or cache after the oldest were dropped."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
