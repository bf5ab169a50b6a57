"""The registered queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, mixing, negatives, pii, resample, sentences, sql, suffixes, topk, toxicity, urls, warc
from .jaccard import shingle_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar documents, by the rules of shingle_components for nulls, repeats and empty tables."""
    return shingle_components(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of each query vector; which vectors take no part is said in top_k."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page, with the bound that it follows from; null urls are judged as the empty host."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each document; und for null texts and those without a letter."""
    return langid.digest(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archive says of each page after it was written and read again; null html is an empty payload."""
    return warc.digest(table(spark, sf_dir, "pages"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated passages, with counts; nulls and short texts stay as they are."""
    return sentences.digest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeated windows cover, and words of repeated runs of 50 words; null texts have no bytes."""
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document with the scores of its spans; null texts have none."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that benchmark windows hit; null texts have no words."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null texts and those without words give none."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document, learned from labels that are not held out; texts without letters score 0."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark's features, and the ranks of those drawn; null texts weigh 0."""
    return resample.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives within the windows below each anchor's positives, labels changed first; which rows take no part is said in mine."""
    return negatives.mine(negatives.relabelled(table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_topk_search, op3_url_filter, op4_language_id, op5_warc, op6_sentence_spans, op7_suffix_dedup, op8_pii, op9_decontaminate, op10_mix, op11_toxicity, op12_resample, op13_hard_negatives,
    )
}
SQL: dict[str, str] = {"op2_topk_search": topk.SQL, "op3_url_filter": sql.URL_FILTER, "op5_warc": sql.WARC, "op9_decontaminate": sql.DECONTAMINATE, "op10_mix": sql.MIX, "op12_resample": resample.SQL, "op13_hard_negatives": negatives.SQL}
