"""Importance resampling against a plain computation, with nulls, odd texts, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import resample
from framewright.llm.textarrays import Words, slices

DOCS = "doc_id long, text string, doc_ids string, WEIGHT double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> list[bytes]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets=10_000, percent=5, least=20):
    s, t = np.zeros(buckets), np.zeros(buckets)
    for texts, of in ((docs, s), ([(None, x) for x in target], t)):
        for _, text in texts:
            for f in features(text):
                of[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall((text or "")))))
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = enough[: percent * len(enough) // 100]
    out = [(*r[:4], None) for r in rows if r not in drawn]
    return sorted([*out, *((*r[:4], n) for n, r in enumerate(drawn, 1))], key=str)


def texts():
    rng = np.random.RandomState(3)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "über", "x" * 70, "y" * 300, "a1", "B2"]
    docs = [(i, " ".join(words[k] for k in rng.randint(len(words), size=n)) + "." * (i % 3)) for i, n in enumerate(rng.randint(0, 60, size=90).tolist())]
    return docs + [(200, None), (201, ""), (202, "--- \t"), (203, "the " * 70000), (204, "one"), (None, "one two three " * 9), (5, docs[5][1]), (6, "another text of the same id")]


@pytest.mark.parametrize("percent", [5, 40])
def test_scores_and_draws(spark, percent):
    docs, target = texts(), ["w1 w2 w3 w1 w2", None, "Ärger über W4", ""]
    df = spark.createDataFrame([(*d, "extra", 1.0) for d in docs], DOCS)
    got = resample.scored(df, spark.createDataFrame([(x,) for x in target], "text string"), percent=percent).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, percent=percent)


def test_hashes_of_features():
    docs = [t or "" for _, t in texts()]
    for a, _, data, offsets in slices(pa.array(docs)):
        words = Words(data, offsets, "alnum")
        row, crc = resample.feature_hashes(resample._LOWER[data], words)
        want = sorted((a + i, zlib.crc32(f)) for i, t in enumerate(docs[a : a + len(offsets) - 1]) for f in features(t))
        assert sorted(zip((row + a).tolist(), crc.tolist())) == want


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample.scored(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in resample.scored(some, target).collect()) == [(1, 87), (2, 0)]


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(*d, "extra", 2.0) for d in texts()], DOCS)
    got = resample.resample(docs, spark.createDataFrame([("w1 w2 w3",)], "text string"), percent=20)
    assert got.columns == docs.columns
    want = {r[0] for r in brute(texts(), ["w1 w2 w3"], percent=20) if r[4]}
    assert {r.doc_id for r in got.collect()} == want
