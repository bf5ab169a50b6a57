"""Media files as rows, trajectory files, and checked writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted extensions, fixed.
EXTENSIONS = ("mp4", "avi", "mov", "mkv", "webm")
COLUMNS = ("frame_idx", "time_ns", "obj_x", "obj_y", "target_x", "target_y", "delta_x", "delta_y", "delta_norm")


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modification time of the media files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def write_trajectory(rows: DataFrame, path: str, folders: bool = False) -> int:
    """Writes clip_id and COLUMNS as CSV by Spark's commit protocol; returns the rows that a re-read counts.

    A file holds many clips, each as a whole and in frame order. With folders each clip has a folder of its own, clip_id=..., and its file has
    COLUMNS alone: files and listings then grow with the clips, at several milliseconds each.
    """
    rows = rows.withColumn("delta_norm", F.sqrt(F.col("delta_x") * F.col("delta_x") + F.col("delta_y") * F.col("delta_y")))
    sorted_rows = rows.repartition("clip_id").sortWithinPartitions("clip_id", "frame_idx").select("clip_id", *COLUMNS)
    writer = sorted_rows.write.partitionBy("clip_id") if folders else sorted_rows.write
    writer.mode("overwrite").option("header", True).csv(path)
    return read_trajectory(rows.sparkSession, path).count()


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """clip_id and COLUMNS of written trajectories, in either form; a file that does not hold them fails."""
    kinds = {"frame_idx": "int", "time_ns": "long"}
    schema = "clip_id long, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path).select("clip_id", *COLUMNS)
