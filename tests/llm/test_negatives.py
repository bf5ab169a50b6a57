"""Hard negatives against a plain computation, with odd vectors, ties, repeats, many blocks and empty tables."""

from __future__ import annotations

import math
import random

import pytest

from framewright.llm import negatives, topk

COLUMNS = "vec_id long, embedding array<double>, label int, sign string, codes string"


def brute(rows, every=50):
    ok = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, label, q in ok:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i, y) for i, y, v in ok if i != a and len(v) == len(q)]
        same, other = sorted(x for x in scored if x[2] == label)[:5], sorted(x for x in scored if x[2] != label)
        for p, pid, _ in same:
            inside = [(n, i) for n, i, _ in other if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(a, pid, r, i, -p, -n) for r, (n, i) in enumerate(inside, 1)}
    return out


def vectors(n=400, d=8, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)], rng.randrange(4)) for i in range(n)]
    same = [0.5] * d
    rows += [(1000 + i, same, i % 2) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2001, [1.0] * (d - 1) + [float("nan")], 1), (2002, [1.0] * (d - 1) + [None], 1), (2003, same, None), (2004, [], 1), (2005, [1e300, float("inf")], 1), (None, same, 1)]
    rows += [(2050, [1.0, 2.0], 0), (2051, [1.0, 1.0], 0), (2052, [0.9, 1.1], 1)]  # other lengths
    return rows + [rows[50], (50, [x + 0.25 for x in rows[50][1]], rows[50][2])]  # a repeated row, an id with two vectors


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "c") for r in rows], COLUMNS)


def test_against_brute_force(spark):
    rows = vectors()
    assert {tuple(r) for r in negatives.mine(frame(spark, rows)).collect()} == brute(rows)


def test_many_blocks_and_few_cells(spark, monkeypatch):
    for name, value in (("ANCHOR_BLOCK", 3), ("ROW_BLOCK", 70), ("CHUNK", 16), ("SAMPLE", 5)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(300, 5, 9)
    got = negatives.mine(frame(spark, rows), every=25)
    assert {tuple(r) for r in got.collect()} == brute(rows, 25)


def test_wide_components(spark):
    rows = [(0, [1e14, 3.0], 0), (1, [1e3, 1e4], 0), (2, [7e2, 9e3], 1), (3, [5e2, -4.0], 1), (50, [1e-3, 1e12], 1), (51, [2.0, 3e5], 1), (52, [3.0, 2e5], 0)]
    got = {tuple(r) for r in negatives.mine(frame(spark, rows)).collect()}
    small = {r for r in brute(rows) if abs(r[4]) < 2**63 and abs(r[5]) < 2**63}
    assert small <= got and all(-(2**63) < r[4] < 2**63 for r in got)


def test_empty(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(50, [1.0], 0)])).count() == 0


@pytest.mark.parametrize("value", [1e17, 1e300])
def test_search_of_vectors_that_take_no_part_or_are_wide(spark, value):
    rows = [(100, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [1e300, float("nan")]), (3, [value, 0.5]), (4, [value, None])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(100, 1, 3), (100, 2, 1)]
    assert got[1].score == 1024 * 1024 * (3 - 2)


def test_search_in_many_blocks(spark, monkeypatch):
    for name, number in (("QUERY_BLOCK", 2), ("CANDIDATE_BLOCK", 40), ("CHUNK", 8), ("SEEDS", 20)):
        monkeypatch.setattr(topk, name, number)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(6)]) for i in range(350)]
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = set()
    for q in range(0, 350, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50)
    assert {tuple(r) for r in got.collect()} == want
