"""Shared storage for cut lineage, and bounded Bloom filters."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, or one of our own in local tests."""
    path = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {SHARED} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SHARED, path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to shared storage and reads it back: lost executors cost no recomputation behind it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; Spark's own limit is in rows, however long their texts.
BATCH_BYTES = "4m"


def bounded(spark: SparkSession) -> None:
    """Has the session cut Arrow batches at BATCH_BYTES, where it sets no limit of its own: this bounds the memory of JVM and workers."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns that no column of df has, whatever its case."""
    taken, own = {c.lower() for c in df.columns}, "_"
    while any((own + n).lower() in taken for n in names):
        own += "_"
    return [own + n for n in names]


def named(names: list[str]) -> list[Column]:
    """The columns of these names, whatever signs they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plainly(docs: DataFrame, run) -> DataFrame:
    """run(docs) with columns whose names hold dots or backticks under plain names meanwhile: mapInArrow cannot take them."""
    odd = [c for c in docs.columns if "." in c or "`" in c]
    if not odd:
        return run(docs)
    other = unused(docs, *(f"odd_{i}" for i in range(len(odd))))
    return run(docs.withColumnsRenamed(dict(zip(odd, other)))).withColumnsRenamed(dict(zip(other, odd)))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote, once nothing is going to read them again; other tables are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = shared_dir(spark).partition(":")[2].rstrip("/") + "/"
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.partition(":")[2].replace("//", "").startswith(own.replace("//", "")):
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, on which Spark deletes the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of a Bloom filter: 8 MB, whatever the input; a fuller filter lets more rows pass, which costs time only.
BLOOM_BITS = 1 << 26


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes.astype(np.uint64) & np.uint64(bits - 1)


def bloom(df: DataFrame, column: str, bits: int = BLOOM_BITS):
    """Broadcasts a bitmap of the well mixed long `column`. Bytes that hold a set bit are merged in Spark; the
    driver gets bits / 8 bytes at most."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    parts = (
        df.where(F.col(column).isNotNull())
        .select((slot / 32768).cast("int").alias("part"), (slot % 32768).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bitmap, np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bloom(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slots(hashes, len(bitmap) * 8)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose long `column` is null or not among the ids of gone (one long column); columns as before.

    Rows that a Bloom filter of the ids rules out pass without a shuffle; the others are settled by an exact anti-join. The
    driver and the broadcast hold 8 MB at most, however many ids there are. Repeated ids and nulls in gone are harmless.
    """
    name = gone.columns[0]
    hashed = F.xxhash64(F.col(column).cast("long"))
    bitmap = bloom(gone.where(F.col(name).isNotNull()).select(F.xxhash64(F.col(name).cast("long")).alias("slot")), "slot")

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(bitmap.value, h.to_numpy()))

    mark, other = unused(df, "maybe", "gone")
    marked = df.withColumn(mark, maybe(hashed))
    own = named(df.columns)
    ids = gone.select(F.col(name).alias(other))
    unsure = marked.where(F.col(mark)).join(ids, F.col(column) == F.col(other), "left_anti")
    return marked.where(~F.col(mark)).select(*own).union(unsure.select(*own))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
