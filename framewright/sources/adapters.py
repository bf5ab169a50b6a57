"""Deterministic engine tables made of the driver's tables; shapes for exercising the operators, not video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str, clip_id: int | None = None) -> DataFrame:
    """clip_id, frame_idx, delta_valid, delta_x, delta_y, center_valid, center_x, center_y from events; of one clip, filtered in the scan."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events")
    events = events if clip_id is None else events.where(F.col("user_id") == clip_id)
    # numbered before the names change, as dets below
    return events.withColumn("frame_idx", (F.row_number().over(w) - 1).cast("int")).select(
        F.col("user_id").alias("clip_id"), "frame_idx", (F.col("event_type") != "error").alias("delta_valid"),
        (F.col("value") - 50.0).alias("delta_x"), (F.regexp_extract("props", "([0-9]+)", 1).cast("double") - 50.0).alias("delta_y"),
        (F.col("event_type") == "signup").alias("center_valid"), F.col("value").alias("center_x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("center_y"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, pt_id, dx, dy from embeddings."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("frame_idx"), F.col("vec_id").alias("pt_id"), (e[0].cast("double") * 10.0).alias("dx"), (e[1].cast("double") * 10.0).alias("dy"))


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, det_id, class_id, score and corners from lineitem."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    # numbered before the names change: in one select Spark would not know that the rows are dealt by frame_idx, and shuffle them again
    rows = table(spark, sf_dir, "lineitem").withColumn("det_id", F.row_number().over(w).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("frame_idx"), "det_id", (F.col("l_linenumber") % 2).alias("class_id"), F.col("l_extendedprice").alias("score"),
        x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity")).alias("y2"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("provider"), F.col("value").alias("total_ms"))


#: Shares of a run's time by stage, in the detector and in an export; made up, fixed.
DETECT_STAGES = {"pre_ms": 0.25, "infer_ms": 0.5, "post_ms": 0.25}
EXPORT_STAGES = {"decode_ms": 0.125, "convert_ms": 0.125, "clear_ms": 0.0625, "copy_ms": 0.1875, "encode_ms": 0.25, "callback_ms": 0.25}


def staged_timings(spark: SparkSession, sf_dir: str, shares: dict[str, float]) -> DataFrame:
    """timings with a column for each stage."""
    return timings(spark, sf_dir).withColumns({s: F.col("total_ms") * share for s, share in shares.items()})


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.col("event_type").isin("click", "view")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), F.when(video, 0).otherwise(1).alias("stream_rank"), F.col("event_id").alias("pkt_id"), (F.col("event_id") * 1000).cast("long").alias("ts_us"), (F.col("event_id") * 1000 + (F.col("value") * 100).cast("long")).alias("dts")
    )
