"""Clip metadata, times, paths and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_rate(average: Column, real: Column, frames: Column, seconds: Column) -> Column:
    """The first positive of: average rate, real base rate, (frames - 1) / seconds, 30."""
    own = lambda x: F.when(x > 0, x)
    return F.coalesce(own(average), own(real), own(F.try_divide(frames - 1, seconds)), F.lit(30.0)).cast("double")


def time_ns(best: Column, pts: Column, num: Column, den: Column, index: Column, fps: Column) -> Column:
    """Best-effort timestamp, else pts, in units of num / den seconds, else index / fps; as whole nanoseconds.

    Ticks are rounded to the nearest nanosecond, halves away from zero; index / fps is truncated. Units that are not positive
    count as none, and without a positive fps either the time is 0.
    """
    ticks = F.when((num > 0) & (den > 0), F.coalesce(best, pts))
    unit = F.when(den > 0, den).otherwise(1).cast("long")
    twice = F.abs(ticks).cast("decimal(18,0)") * num.cast("decimal(9,0)") * F.lit(2_000_000_000).cast("decimal(10,0)") + unit.cast("decimal(10,0)")
    half = (twice - twice % (unit * 2).cast("decimal(10,0)")) / (unit * 2).cast("decimal(10,0)")
    exact = (F.signum(ticks).cast("long") * half.cast("long")).cast("long")
    return F.coalesce(exact, (F.try_divide(index, F.when(fps > 0, fps)) * 1e9).cast("long"), F.lit(0).cast("long"))


def stem(path: Column) -> Column:
    """The file name without its last extension; null where there is none."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.when(name != "", F.when(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1) != "", F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name))


def parent(path: Column) -> Column:
    """Null for a bare name; a file at the root lies in the root."""
    folder = F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
    return F.when(folder != "", folder).when(path.rlike(r"^[/\\]"), F.substring(path, 1, 1))


def with_mp4(path: Column) -> Column:
    """Without white space at either end."""
    p = F.regexp_replace(path, r"^\s+|\s+$", "")
    return F.when((p == "") | F.lower(p).endswith(".mp4"), p).otherwise(F.concat(p, F.lit(".mp4")))


def export_name(base: Column) -> Column:
    return F.concat(F.coalesce(F.when(base != "", base), F.lit("output")), F.lit("_export.mp4"))


def padded(n: Column, width: int = 6) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def to_bps(mbps: Column) -> Column:
    return (mbps * 1_000_000).cast("long")


def shown_mbps(bps: Column) -> Column:
    return F.least(F.lit(200), F.greatest(F.lit(1), F.floor(bps / 1048576 + 0.5))).cast("int")


def video_kbps(seconds: Column, megabytes: int = 90, audio_kbps: int = 128) -> Column:
    """What is left for video of a target size; null without a duration."""
    return F.when(seconds > 0, F.floor(F.lit(megabytes * 1024 * 8) / seconds) - audio_kbps).cast("long")


def progress(index: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), index / F.greatest(total, F.lit(1)))).otherwise(0.0)


def progress_text(index: Column, total: Column) -> Column:
    percent = F.floor(progress(index, total) * 100).cast("int").cast("string")
    return F.concat(F.lit("frame "), index.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), percent, F.lit("%)"))


def realtime_factor(total_ms: Column, fps: Column) -> Column:
    return F.try_divide(F.lit(1000.0), total_ms * fps)


def bandwidth_gbs(frame_bytes: Column, total_ms: Column) -> Column:
    """Estimated memory traffic in GB a second: five passes over a frame in its time; 0 without a time."""
    return F.when(total_ms > 1e-9, F.try_divide(frame_bytes * 5.0, total_ms / 1000.0) / 1e9).otherwise(0.0)


def sample_offset(first_us: Column, start_us: Column, rate: int = 48_000) -> Column:
    """Samples of silence to put before (> 0) or to drop (< 0), truncated toward zero."""
    x = (first_us - start_us) * rate
    return (F.signum(x) * F.floor(F.abs(x) / 1_000_000)).cast("long")
