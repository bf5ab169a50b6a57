"""The least-squares paths against dense solves: any sigmas, Huber weights round by round, clips in one block and in many, gaps."""

from __future__ import annotations

import numpy as np
import pytest

from framewright.operators import paths, trajectory
from framewright.operators.banded import Chain, Smooth

TRACKS = "clip_id long, frame_idx int, delta_valid boolean, delta_x double, delta_y double, center_valid boolean, center_x double, center_y double"


def huber(r, d=6.0):
    return np.where(r > d, d / np.maximum(r, 1e-300), 1.0)


def rounds_of(x, solve, robust, still=1e-8):
    """Solves again with the last round's weights; the mean moves of the rounds."""
    moves = []
    for _ in range(robust.rounds if robust else 1):
        new = solve(x if robust else None)
        moves.append(np.linalg.norm(new - x, axis=1).mean())
        x = new
        if moves[-1] < still:
            break
    return x, moves


def dense_object(t, detected, weak, step, no_step, robust):
    n = len(t)
    m = np.array([[r[6], r[7]] if r[5] else [480.0, 270.0] for r in t])
    w = np.array([detected**-2.0 if r[5] else weak**-2.0 for r in t])
    b = np.array([step**-2.0 if r[2] else no_step**-2.0 for r in t])
    d = np.array([[r[3], r[4]] if r[2] else [0.0, 0.0] for r in t])

    def solve(p):
        u = w if p is None else w * huber(np.linalg.norm(p - m, axis=1))
        s = b[1:] if p is None else b[1:] * huber(np.linalg.norm(p[1:] - p[:-1] - d[1:], axis=1))
        e = np.diff(np.eye(n), axis=0)
        return np.linalg.solve(np.diag(u) + e.T @ np.diag(s) @ e, u[:, None] * m + e.T @ (s[:, None] * d[1:]))

    return rounds_of(m, solve, robust)


def dense_smooth(m, v, a, w, robust):
    n = len(m)
    d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), n=2, axis=0)

    def solve(x):
        u = np.full(n, w) if x is None else w * huber(np.linalg.norm(x - m, axis=1))
        return np.linalg.solve(np.diag(u) + v * d1.T @ d1 + a * d2.T @ d2, u[:, None] * m)

    return rounds_of(m, solve, robust)


def clips():
    rng = np.random.RandomState(0)
    out = {}
    for clip, n in ((1, 1), (2, 2), (3, 3), (4, 40), (5, 57)):
        index = np.sort(rng.choice(3 * n, n, replace=False)) if clip == 5 else np.arange(n)  # one with gaps
        out[clip] = [(clip, int(i), bool(rng.rand() < 0.7), *(rng.randn(2) * 5).tolist(), bool(rng.rand() < 0.2), *(rng.rand(2) * 900).tolist()) for i in index]
    return out


def near(got, want):
    assert np.abs(np.array(got) - want).max() < 1e-6


@pytest.mark.parametrize(("robust", "block"), [(None, None), (None, 8), (paths.Robust(), None), (paths.Robust(rounds=2), 8)])
def test_object_path(spark, robust, block):
    sigmas = (2.0, 5.0, 3.0, 80.0)
    df = spark.createDataFrame([r for t in clips().values() for r in t], TRACKS)
    path, rounds = paths.object_path(df, detected=sigmas[0], weak=sigmas[1], step=sigmas[2], no_step=sigmas[3], robust=robust, block=block)
    got = {(r.clip_id, r.frame_idx): (r.x, r.y) for r in path.collect()}
    told = {(r.clip_id, r["round"]): (r.moved, r.stopped) for r in rounds.collect()}
    assert len(got) == sum(map(len, clips().values()))
    for clip, t in clips().items():
        want, moves = dense_object(t, *sigmas, robust)
        near([got[clip, r[1]] for r in t], want)
        mine = [told[clip, n] for n in range(len(moves))]
        near([m for m, _ in mine], moves)
        assert (clip, len(moves)) not in told
        if robust and block is None:
            assert [s for _, s in mine] == [m < 1e-8 for m in moves]


@pytest.mark.parametrize(("robust", "block"), [(None, 8), (paths.Robust(), None), (paths.Robust(rounds=2), 16)])
def test_smooth_path(spark, robust, block):
    rows = [(c, r[1], r[6], r[7]) for c, t in clips().items() for r in t]
    df = spark.createDataFrame(rows, "clip_id long, frame_idx int, x double, y double")
    out, rounds = paths.smooth(df, 20.0, 25.0, 26.5, robust=robust, block=block)
    got = {(r.clip_id, r.frame_idx): (r.smooth_x, r.smooth_y) for r in out.collect()}
    told = {(r.clip_id, r["round"]): r.moved for r in rounds.collect()}
    for clip, t in clips().items():
        want, moves = dense_smooth(np.array([[r[6], r[7]] for r in t]), 20.0**-2, 25.0**-2, 26.5**-2, robust)
        near([got[clip, r[1]] for r in t], want)
        near([told[clip, n] for n in range(len(moves))], moves)


def test_default_sigmas_are_the_closed_form(spark):
    df = spark.createDataFrame([r for t in clips().values() for r in t], TRACKS)
    closed = {(r.clip_id, r.frame_idx): r.position for r in trajectory.anchored(df, 480.0).collect()}
    path, _ = paths.object_path(df, block=16)
    assert {(r.clip_id, r.frame_idx): r.x for r in path.collect()} == pytest.approx(closed, abs=1e-3)


def test_one_axis_and_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 5.0), (1, 2, 2.0), (2, 0, 1.0), (2, 1, float("inf"))], "clip_id long, frame_idx int, position double")
    got = {(r.clip_id, r.frame_idx): r.smooth_position for r in paths.smoothed(df).collect()}
    data, motion = trajectory.smoothing_sigmas(0.5)
    want, _ = dense_smooth(np.array([[1.0, 0], [5.0, 0], [2.0, 0]]), motion**-2, motion**-2, data**-2, None)
    assert [got[1, i] for i in range(3)] == pytest.approx(want[:, 0].tolist())
    assert got[2, 0] == 1.0 and got[2, 1] == float("inf")  # no finite solution: the input
    assert paths.smoothed(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 5, 100])
def test_blocks_of_frames_give_the_whole_solution(block):
    rng = np.random.RandomState(1)
    for n in (1, 2, 5, 9, 13, 37):
        m, w, b = rng.randn(n, 2), rng.rand(n) + 0.01, rng.rand(n) + 0.1
        cut = [(s, min(block, n - s)) for s in range(0, n, block)]
        first, size, of = np.array([s for s, _ in cut]), np.array([k for _, k in cut]), np.full(len(cut), n)
        high = size.max()
        pad = lambda v, fill: np.stack([np.concatenate((v[s : s + k], np.full((high - k, *v.shape[1:]), fill))) for s, k in cut], 1)
        kernel = Smooth(0.3, 0.7)
        edges = kernel.edges(kernel.reduce(pad(w, 1.0), pad(m, 0.0), first, of, size), 2)
        none = np.zeros((1, 2, 2))
        x = kernel.expand(pad(w, 1.0), pad(m, 0.0), first, of, size, np.concatenate((none, edges)), np.concatenate((edges, none)))
        d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), n=2, axis=0)
        near(np.concatenate([x[:k, j] for j, (_, k) in enumerate(cut)]), np.linalg.solve(np.diag(w) + 0.3 * d1.T @ d1 + 0.7 * d2.T @ d2, w[:, None] * m))
        chain = Chain()
        edges = chain.edges(chain.reduce(pad(w, 1.0), pad(m, 0.0), pad(b, 0.0), first, of, size), 2)
        x = chain.expand(pad(w, 1.0), pad(m, 0.0), pad(b, 0.0), first, of, size, np.concatenate((none[:, :1], edges[:-1])), edges)
        near(np.concatenate([x[:k, j] for j, (_, k) in enumerate(cut)]), np.linalg.solve(np.diag(w) + d1.T @ np.diag(b[1:]) @ d1, w[:, None] * m))
