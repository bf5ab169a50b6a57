"""Packets of a clip: shared start, interleaving, monotonic stamps, chunks of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024


def shared_start(packets: DataFrame, stamp: str = "ts_us") -> DataFrame:
    """Stamps less the clip's earliest one."""
    return packets.withColumn(stamp, F.col(stamp) - F.min(stamp).over(Window.partitionBy("clip_id")))


def interleaved(video: DataFrame, audio: DataFrame) -> DataFrame:
    """Packets of both in writing order: by stamp, video first on ties; `position` counts from 0 within a clip."""
    both = video.withColumn("stream_rank", F.lit(0)).unionByName(audio.withColumn("stream_rank", F.lit(1)))
    w = Window.partitionBy("clip_id").orderBy("ts_us", "stream_rank", "pkt_id")
    return both.withColumn("position", F.row_number().over(w) - 1)


def monotonic(packets: DataFrame, stamp: str = "dts", order: str = "pkt_id", shown: str | None = None) -> DataFrame:
    """Adds `safe`: the running maximum of the stamp within a stream of a clip; with `shown`, the stamp of presentation, also `safe_shown`.

    A presentation stamp below the decoding stamp is raised to it where the latter was raised, and is left alone elsewhere.
    """
    w = Window.partitionBy("clip_id", "stream_rank").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = packets.withColumn("safe", F.max(stamp).over(w))
    raised = F.col(stamp) < F.col("safe")
    return out.withColumn("safe_shown", F.when(raised, F.greatest(shown, "safe")).otherwise(F.col(shown))) if shown else out


def chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """Samples (clip_id, sample_idx) dealt out in fixed chunks: clip_id, chunk, n, padding of the last one."""
    w = Window.partitionBy("clip_id").orderBy("sample_idx")
    numbered = samples.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return numbered.groupBy("clip_id", "chunk").agg(F.count("*").alias("n")).withColumn("padding", F.lit(size) - F.col("n"))
