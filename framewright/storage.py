"""Cut lineage on storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    path = spark.conf.get(SHARED, None) or context.getConf().get(SHARED)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {SHARED} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SHARED, path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the session's checkpoint folder; lost executors cost no recomputation behind it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, size: str = "16m") -> DataFrame:
    """df, in a session that cuts Arrow batches at `size` bytes where it sets no limit of its own."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, size)
    return df
