"""The corpus pipeline: language, near copies, benchmark passages, personal data, and the final mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import decontaminate, langid, mixing, pii
from framewright.llm.jaccard import shingle_components
from framewright.llm.storage import saved, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language is not told with a margin."""
    return langid.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: that with the smallest id, null ids last.

    Where ids repeat or are null, rows are told apart by id and text. Rows alike in both are copies, and one stays; rows of
    one id with two texts are two documents. Texts without words are similar to none.
    """
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if counted.where("n > 1 or doc_id is null").isEmpty():
        groups = shingle_components(docs).select(F.col("doc_id").alias("k_id"), F.col("component_id").alias("k_group"))
        return without(docs, "doc_id", saved(groups.where("k_id <> k_group").select("k_id"), "copies"))
    names = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    keys = saved(keyed.groupBy("_key").agg(F.first("doc_id").alias("k_id"), F.count("*").alias("n")), "keys")
    groups = shingle_components(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("k_group")).distinct()
    groups = saved(groups.join(keys, "_key"), "groups")
    least = groups.groupBy("k_group").agg(F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "_key")).alias("least"))
    copies = saved(groups.join(least, "k_group").where("_key <> least._key").select("_key"), "copies")
    kept = without(keyed, "_key", copies)
    repeated = saved(keys.where("n > 1").select("_key"), "repeated")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(*(F.col(c) for c in names)))
    once = kept.join(repeated, "_key", "left_semi").withColumn("_nth", nth).where("_nth = 1")
    return without(kept, "_key", repeated).select(*names).union(once.select(*names))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a run of ten words of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by tags."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each taken copy, with its shard and its place there."""
    return mixing.mix(docs)


STAGES = [("language", language), ("near copies", near_copies), ("benchmark", benchmark), ("personal data", personal_data), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression and the redaction's folds have no SQL form; tests/llm/test_pipeline.py holds near copies, benchmark and personal data
#: against brute force on small tables. The language stage and the whole run are not.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
