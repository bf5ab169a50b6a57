"""Operators whose tables are held block by block give what one block gives; column names of any kind come through."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewright.llm import decontaminate, langid, mixing, pii, sentences, storage


def speech(rng: random.Random, lang: int, n: int = 40) -> str:
    return " ".join(f"{chr(97 + lang % 26)}{chr(97 + lang // 26)}{rng.choice('aeiou')}{chr(97 + (lang * 7) % 26)}{rng.choice('lmnr')}" for _ in range(n))


def test_languages_in_blocks(spark, monkeypatch):
    """300 languages: none is left out, and blocks of any size tell what one block tells."""
    rng = random.Random(1)
    train = [(3 * i + k, speech(rng, i), f"l{i:03}") for i in range(300) for k in range(2 + (i % 2))]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    texts = spark.createDataFrame([(i, speech(rng, i)) for i in range(0, 300, 5)] + [(900, None), (901, "123")], "doc_id long, text string")
    assert sum(len(m.dictionaries) for m in langid.fit(df)) == 300
    got = []
    for size in (400, 130, 90):
        found = langid.identify(texts, langid.fit(df, block_langs=size), keep_text=size == 130)
        got.append({r.doc_id: (r.lang_pred, r.score) for r in found.collect()})
    assert got[0] == got[1] == got[2]
    assert sum(got[0][i][0] == f"l{i:03}" for i in range(0, 300, 5)) > 55 and got[0][900] == got[0][901] == ("und", 0.0)


@pytest.mark.parametrize("block", [1, 7])
def test_benchmark_in_blocks(spark, block):
    rng = random.Random(2)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [(f"i{k}", words(rng.choice((3, 9, 10, 14, 25)))) for k in range(12)] + [(None, words(12)), ("i0", "again one two")]
    docs = [(k, words(30) + " " + items[k % 14][1] + " " + words(5)) for k in range(30)] + [(100, None), (101, "")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda n: sorted((r.doc_id, r._n, r._hits, r._items) for r in decontaminate.scan(df, bench, block_windows=n).collect())
    assert rows(block) == rows(1_000_000)
    assert sum(len(r[2]) > 0 for r in rows(block)) == 30


def test_column_names_of_any_kind(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i} for you. Mail me at a{i}@b.org today, it is fine", "en", "s", "x") for i in range(8)], "doc_id long, text string, lang string, source string, a string")
    docs = docs.select("doc_id", "text", "lang", "source", F.col("a").alias("a.b"), F.col("a").alias("PII_Spans"), F.col("a").alias("Lang_Pred"), F.col("a").alias("x y"))
    bench = spark.createDataFrame([("x", "nothing of this is there at all in any text here")], "item_id string, text string")
    gone = spark.createDataFrame([(3,)], "k long")
    names = storage.named(docs.columns)
    for out in (pii.redact(docs), decontaminate.clean(docs, bench), storage.without(docs, "doc_id", gone), mixing.mix(docs), sentences.dedup(docs), langid.accepted(docs, 0.0)):
        got = out.select(*names).collect()
        assert got and all(tuple(r)[4:] == ("x",) * 4 for r in got)


def test_tree_keeps_quotas_and_halves(spark):
    """Every source's blocks are as many as its quota, disjoint over shards, and each node's children get exactly their shares."""
    targets = spark.createDataFrame([("a", 1000.0), ("b", 377.0), (None, 123.0)], "source string, target double")
    tree = mixing.splitting_tree(targets, 5, 12, 3).collect()
    whole = 1500.0
    for source, target in (("a", 1000.0), ("b", 377.0), (None, 123.0)):
        own = sorted(r.block for r in tree if r.source == source)
        assert own == list(range(-(-int(target * 60) // int(whole))))
    n = len(tree)
    sizes = [sum(r.shard == k for r in tree) for k in range(5)]
    left = n * 2 // 5
    assert sum(sizes) == n and sizes[0] + sizes[1] == left and sizes[0] == left // 2 and sizes[2] == (n - left) // 3
