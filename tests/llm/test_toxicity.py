"""The toxicity operator: its pieces and kernel by plain code, held-out accuracy on invented and given texts, odd inputs."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.llm import queries, toxicity
from framewright.llm.textarrays import slices

INSULTS = ["blockhead", "numbskull", "dimwit"]


def corpus(n: int, seed: int = 2):
    rng = random.Random(seed)
    parts = "ka lo mi ten ra su vel dor nim pa".split()
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        yield i, " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)), int(bad)


@pytest.fixture(scope="module")
def model():
    rows = list(corpus(600))
    return toxicity.train([t for _, t, _ in rows], np.array([2 * y - 1 for *_, y in rows]))


def pieces(texts):
    out = []
    for a, _, data, offsets in slices(pa.array(texts, pa.large_string())):
        p = toxicity.pieces_of(data, offsets)
        out += [(a + int(r), p.letters[s:e].tobytes()) for r, s, e in zip(p.row, p.start, p.end)]
    return out


def test_pieces():
    got = pieces(["Hello, w.o-r__ld! i d i o t", "", "...", "a b", "ÄB", "x y", "z"])
    assert got == [(0, b"hello"), (0, b"w\x01o\x01r\x01ld"), (0, b"i\x01d\x01i\x01o\x01t"), (3, b"a"), (3, b"b"), (4, "äb".encode()), (5, b"x"), (5, b"y"), (6, b"z")]
    long_ = "".join(chr(97 + i % 26) for i in range(100))
    cut = [w.decode() for _, w in pieces([long_])]
    assert all(len(w) <= toxicity.LONGEST for w in cut) and all(any(long_[i : i + 12] in w for w in cut) for i in range(88))


def test_kernel_is_that_of_gapped_subsequences():
    def vector(word: bytes):
        codes = [1, *toxicity._CODE[np.frombuffer(word, np.uint8)].tolist(), 2]
        out = {}
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i < toxicity.SPAN and codes[i] and codes[j] and codes[k]:
                key = (codes[i] << 12) | (codes[j] << 6) | codes[k]
                out.setdefault(key, []).append(toxicity.DECAY ** (k - i - 2))
        return {k: sum(v) for k, v in out.items()}, math.sqrt(sum(x * x for v in out.values() for x in v))

    words = [b"idiot", b"id\x01iot", b"idxiot", b"i\x01d\x01i\x01o\x01t", b"radio", b"a", b"aaaaaa"]
    space = toxicity._Landmarks(words)
    got = space.matrix @ space.matrix.T
    for (i, x), (j, y) in itertools.product(enumerate(words), repeat=2):
        (a, m), (b, n) = vector(x), vector(y)
        assert got[i, j] == pytest.approx(sum(v * b.get(k, 0) for k, v in a.items()) / (m * n))
    assert got[0, 1] > got[0, 4] and got[0, 2] > got[0, 4] and got[0, 3] > got[0, 4]  # disguised ones are nearer than another word


def test_the_table_gives_the_function_of_the_landmarks():
    words = [b"blockhead", b"block\x01head", b"kalomi", b"ten"]
    space = toxicity._Landmarks(words[:3])
    w = np.arange(1.0, space.turn.shape[1] + 1)
    assert toxicity.decisions(*toxicity._joined(words), space.table(w)) == pytest.approx(space.map(words) @ w)


def scores(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}


def test_held_out_and_disguised(spark, model):
    rows = list(corpus(300, 77))
    got = scores(spark, model, [t for _, t, _ in rows])
    assert sum((got[i].score >= 0.5) == y for i, (_, _, y) in enumerate(rows)) >= 295
    base = "kalo miten ravel "
    odd = scores(spark, model, [base + w + " dornim" for w in ("numbskull", "numb-skull", "NUMBSKULL!", "n.umbskull", "nuumbskull", "blockhxead", "b l o c k h e a d")])
    assert all(r.score >= 0.5 for r in odd.values()), {k: r.score for k, r in odd.items()}
    assert odd[1].evidence == "numb-skull"


def test_odd_texts(spark, model):
    long_ = "kalo miten ravel. " * 9000
    got = scores(spark, model, [None, "", " \t", "...", "A", long_, long_ + "dimwit", long_ + "dimwit", "𝄞" * 50, "kalo"])
    assert [got[i].score for i in range(4)] == [0.0] * 4
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[5].score < 0.5 <= got[6].score == got[7].score and got[6].evidence == "dimwit"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.digest(docs, none).collect()] == [(0.0, 0)] * 2
    one = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.digest(docs, one).collect()] == [(0.0, 0)] * 2
    assert toxicity.digest(docs.limit(0), none).count() == 0


def test_filter_keeps_columns(spark, model):
    docs = spark.createDataFrame([(1, "kalo dimwit miten", 0.1, "e"), (2, "kalo miten", 0.2, "f"), (3, None, 0.3, "g"), (2, "kalo miten", 0.2, "f")], "doc_id long, text string, Score double, evidence string")
    got = toxicity.kept(docs, model)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(2, "kalo miten", 0.2, "f"), (2, "kalo miten", 0.2, "f"), (3, None, 0.3, "g")]


def test_query_on_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op11_toxicity(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    right = got.join(labels, "doc_id").where("held_out").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9
