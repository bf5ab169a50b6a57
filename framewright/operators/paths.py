"""Least-squares paths of clips: step 1 with any sigmas and step 2, plain or with Huber weights, by blocks of frames.

Frames are gathered into blocks. Clips of one block are solved many at a time in Arrow batches, all rounds in one pass. Longer
clips are solved in rounds of Spark jobs: every block is eliminated by itself, a clip's block edges meet in a small system,
and the blocks are put back; no clip is in one task. Rounds end clip by clip when the mean move of a frame is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded, cut
from .banded import Chain, Smooth
from .trajectory import smoothing_sigmas

#: Frames of a block; frames that are solved together in a task.
BLOCK, TOGETHER = 4096, 1 << 18
#: Sigmas in pixels of step 1: a detection, the image's centre where there is none, a measured step, a step without measurement.
DETECTED, CENTRE, STEP, NO_STEP = 1e8, 2e6, 1.0, 80.0
HUBER, ROUNDS, STILL = 6.0, 100, 1e-8


class Robust(NamedTuple):
    """Huber weights beyond `delta`, solved again at most `rounds` times until a frame's mean move is below `still`."""

    delta: float = HUBER
    rounds: int = ROUNDS
    still: float = STILL


def weight(sigma: float) -> float:
    """1 / sigma^2, with 1e-3 for a sigma that is not positive and finite."""
    return (sigma if np.isfinite(sigma) and sigma > 0 else 1e-3) ** -2


def blocks(rows: DataFrame, columns: list[str], sums: dict[str, Column] | None = None, block: int | None = None) -> DataFrame:
    """rows (clip_id, frame_idx, columns) by block: clip_id, part, first (position of its first frame), size, n (frames of the clip), frames,
    the columns as arrays in frame order, and for each of `sums` its sum over all earlier blocks of the clip.

    A block holds the frames whose index divided by `block` is the same; positions come from the blocks' sizes, so no task sees a whole clip.
    """
    part, sums = F.floor(F.col("frame_idx") / (block or BLOCK)).alias("part"), sums or {}
    sizes = rows.groupBy("clip_id", part).agg(F.count("*").alias("size"), *(F.sum(c).alias(n) for n, c in sums.items()))
    clip = Window.partitionBy("clip_id")
    earlier = clip.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    placed = sizes.select("clip_id", "part", "size", total("size").alias("first"), F.sum("size").over(clip).alias("n"), *(total(n).cast("double").alias(n) for n in sums))
    listed = rows.groupBy("clip_id", part).agg(F.sort_array(F.collect_list(F.struct("frame_idx", *columns))).alias("r"))
    arrays = [F.col("r.frame_idx").alias("frames"), *(F.col(f"r.{c}").alias(c) for c in columns)]
    return listed.join(placed, ["clip_id", "part"]).select("clip_id", "part", "first", "size", "n", *sums, *arrays)


def _padded(lists: pa.Array, rows: int, fill: float = 0.0) -> np.ndarray:
    out = np.full((rows, len(lists)), fill)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = np.diff(offsets)
    column = np.repeat(np.arange(len(lists)), size)
    out[np.arange(len(flat)) - np.repeat(offsets[:-1], size), column] = flat
    return out


def _array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class _System:
    """The systems of some blocks: weights and measurements, and the kernel that solves them."""

    def __init__(self, rows: pa.RecordBatch, axes: int, kind, settings, robust: Robust | None):
        self.rows, self.axes, self.kernel, self.robust = rows, axes, kind(*settings), robust
        number = lambda c: rows.column(c).to_numpy().astype(np.int64)
        self.first, self.size, self.n = number("first"), number("size"), number("n")
        self.high = int(self.size.max())
        self.there = np.arange(self.high)[:, None] < self.size
        self.m = np.stack([_padded(_array(rows.column(f"m{k}")), self.high) for k in range(axes)], 2)
        self.w = np.where(self.there, _padded(_array(rows.column("w")), self.high), 1.0)
        self.b = _padded(_array(rows.column("b")), self.high) if kind is Chain else None
        self.x = np.stack([_padded(_array(rows.column(f"x{k}")), self.high) for k in range(axes)], 2) if "x0" in rows.schema.names else self.m.copy()

    def _huber(self, r: np.ndarray) -> np.ndarray:
        d = max(self.robust.delta, 1e-6)
        far = np.isfinite(r) & (r > d)
        return np.where(far, d / np.where(far, r, 1.0), 1.0)

    def weights(self, pick, left: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The kernel's weights for the blocks `pick`; left: the frame before each block as the last round had it."""
        w, x = self.w[:, pick], self.x[:, pick]
        robust = self.robust is not None
        if robust:
            w = w * self._huber(np.sqrt(((x - self.m[:, pick]) ** 2).sum(2)))
        if self.b is None:
            return w, self.m[:, pick]
        b = self.b[:, pick]
        if robust:
            ahead = np.concatenate((x[:1] if left is None else left[None, pick], x[:-1]))
            b = b * self._huber(np.sqrt(((x - ahead) ** 2).sum(2)))
        return w, self.m[:, pick], b

    def solve(self) -> list[list[float]]:
        """Solves the blocks, which are whole clips, round by round; returns the mean moves of each block's rounds."""
        moves: list[list[float]] = [[] for _ in self.size]
        live = np.arange(len(self.size))
        none = np.zeros((len(live), self.kernel.edge, self.axes))
        for _ in range(max(1, self.robust.rounds) if self.robust else 1):
            new = self.kernel.expand(*self.weights(live), self.first[live], self.n[live], self.size[live], none[live], none[live])
            moved = self.take(live, new) / self.size[live]
            for k, v in zip(live.tolist(), moved.tolist()):
                moves[k].append(v)
            live = live[~(moved < (self.robust.still if self.robust else np.inf))]
            if not len(live):
                break
        return moves

    def take(self, pick, new: np.ndarray) -> np.ndarray:
        """Puts the solutions in; an axis of a block that is not finite keeps its measurements. Returns the sum of the frames' moves."""
        there = self.there[:, pick]
        finite = (np.isfinite(new) | ~there[:, :, None]).all(0)
        new = np.where(finite, new, self.m[:, pick])
        moved = np.where(there, np.sqrt(((new - self.x[:, pick]) ** 2).sum(2)), 0.0).sum(0)
        self.x[:, pick] = np.where(there[:, :, None], new, 0.0)
        return moved

    def arrays(self, x: np.ndarray | None = None) -> list[pa.Array]:
        offsets = pa.array(np.concatenate(([0], np.cumsum(self.size))).astype(np.int32))
        x = self.x if x is None else x
        return [pa.ListArray.from_arrays(offsets, pa.array(x[:, :, k].T[self.there.T])) for k in range(self.axes)]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with blocks of like size: at most TOGETHER frames, padding included."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy()
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):
            take = max(1, TOGETHER // max(1, int(size[order[at]])))
            yield batch.take(pa.array(order[at : at + take]))
            at += take


def _whole(axes: int, kind, settings, robust):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            s = _System(rows, axes, kind, settings, robust)
            moves = s.solve()
            yield pa.record_batch([rows.column("clip_id"), rows.column("frames"), *s.arrays(), rows.column("c0"), rows.column("c1"), pa.array(moves, pa.list_(pa.float64()))], names=["clip_id", "frames", "x0", "x1", "c0", "c1", "moves"])

    return run


def _reduced(axes: int, kind, settings, robust):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            s = _System(rows, axes, kind, settings, robust)
            everyone = np.arange(len(s.size))
            parts = s.kernel.reduce(*s.weights(everyone, _left(rows, axes)), s.first, s.n, s.size)
            yield pa.record_batch([rows.column("clip_id"), rows.column("first"), pa.array(list(parts), pa.list_(pa.float64()))], names=["clip_id", "first", "parts"])

    return run


def _left(rows: pa.RecordBatch, axes: int) -> np.ndarray:
    return np.array(rows.column("left").to_pylist(), float).reshape(len(rows), -1, axes)[:, -1]


def _edges(axes: int, kind, settings):
    def run(clip: pd.DataFrame) -> pd.DataFrame:
        kernel = kind(*settings)
        clip = clip.sort_values("first")
        values = kernel.edges(np.array(clip["parts"].tolist(), float), axes)
        none = np.zeros((1, kernel.edge, axes))
        left = np.concatenate((none, values[: len(clip) - 1])).reshape(len(clip), -1)
        right = np.concatenate((values, none))[: len(clip)].reshape(len(clip), -1)
        return pd.DataFrame({"clip_id": clip["clip_id"].to_numpy(), "first": clip["first"].to_numpy(), "new_left": left.tolist(), "right": right.tolist()})

    return run


def _expanded(axes: int, kind, settings, robust):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _together(batches):
            s = _System(rows, axes, kind, settings, robust)
            everyone = np.arange(len(s.size))
            side = lambda c: np.array(rows.column(c).to_pylist(), float).reshape(len(rows), -1, axes)
            left, right = side("new_left"), side("right")
            new = s.kernel.expand(*s.weights(everyone, _left(rows, axes)), s.first, s.n, s.size, left, right)
            moved = s.take(everyone, new)
            names = [c for c in rows.schema.names if c not in ("x0", "x1", "left", "new_left", "right", "moved")]
            yield pa.record_batch([*map(rows.column, names), *s.arrays(), rows.column("new_left"), pa.array(moved)], names=[*names, *(f"x{k}" for k in range(axes)), "left", "moved"])

    return run


_STATE = "clip_id long, first long, size long, n long, frames array<int>, w array<double>, b array<double>, m0 array<double>, m1 array<double>, c0 array<double>, c1 array<double>"
_FOUND = "clip_id long, frames array<int>, x0 array<double>, x1 array<double>, c0 array<double>, c1 array<double>"


def _solved(state: DataFrame, kind, settings, robust: Robust | None) -> tuple[DataFrame, DataFrame]:
    """state: blocks with weights and measurements of both axes -> the blocks of _FOUND, and (clip_id, round, moved, stopped)."""
    state = cut(bounded(state).select(*(f.split()[0] for f in _STATE.split(", "))))
    whole = state.where("size = n").mapInArrow(_whole(2, kind, settings, robust), _FOUND + ", moves array<double>")
    still = robust.still if robust else float("inf")
    rounds = whole.select("clip_id", F.posexplode("moves").alias("round", "moved")).withColumn("stopped", F.col("moved") < still)
    found = whole.drop("moves")
    long_ = state.where("size < n")
    if long_.isEmpty():
        return found, rounds
    both = kind(*settings).edge * 2
    live = cut(long_.withColumns({"x0": F.col("m0"), "x1": F.col("m1"), "left": F.array_repeat(F.lit(0.0), both)}))
    if kind is Chain:  # where the last frame of the block before stands at first
        last = live.select(F.col("clip_id").alias("l_clip"), (F.col("first") + F.col("size")).alias("l_first"), F.array(F.element_at("x0", -1), F.element_at("x1", -1)).alias("l_left"))
        joined = live.join(last, (F.col("clip_id") == F.col("l_clip")) & (F.col("first") == F.col("l_first")), "left")
        live = cut(joined.withColumn("left", F.coalesce("l_left", "left")).drop("l_clip", "l_first", "l_left"))
    names = live.columns
    for n in range(max(1, robust.rounds) if robust else 1):
        parts = live.mapInArrow(_reduced(2, kind, settings, robust), "clip_id long, first long, parts array<double>")
        edges = parts.groupBy("clip_id").applyInPandas(_edges(2, kind, settings), "clip_id long, first long, new_left array<double>, right array<double>")
        met = live.join(edges, ["clip_id", "first"])
        live = cut(met.mapInArrow(_expanded(2, kind, settings, robust), _STATE + ", x0 array<double>, x1 array<double>, left array<double>, moved double"))
        moved = cut(live.groupBy("clip_id").agg((F.sum("moved") / F.first("n")).alias("mean")))  # a row for each long clip
        rounds = rounds.unionByName(moved.select("clip_id", F.lit(n).alias("round"), F.col("mean").alias("moved"), (F.col("mean") < still).alias("stopped")))
        at_rest = moved.where(F.col("mean") < still).select("clip_id")
        found = found.unionByName(live.join(at_rest, "clip_id", "left_semi").select(*found.columns))
        live = live.join(at_rest, "clip_id", "left_anti").select(*names)
        if n + 1 == (robust.rounds if robust else 1) or live.isEmpty():
            break
    return found.unionByName(live.select(*found.columns)), rounds


def _exploded(found: DataFrame, names: tuple[str, str]) -> DataFrame:
    zipped = F.explode(F.arrays_zip("frames", "x0", "x1", "c0", "c1")).alias("r")
    return found.select("clip_id", zipped).select("clip_id", F.col("r.frames").alias("frame_idx"), *((F.col(f"r.x{k}") + F.col(f"r.c{k}")).alias(n) for k, n in enumerate(names)))


def _same(value, of: str) -> Column:
    return F.transform(of, lambda _: F.lit(float(value)))


def smooth(rows: DataFrame, velocity: float, acceleration: float, data: float, of: tuple[str, ...] = ("x", "y"), robust: Robust | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Step 2: (clip_id, frame_idx, smooth_<axis>) and the rounds (clip_id, round, moved, stopped) of rows (clip_id, frame_idx, one or two axes).

    Sigmas: velocity, acceleration, data. The axes share their Huber weights. A clip of which a block's axis has no finite solution keeps its
    input there. frame_idx is unique in a clip; without robust there is one round, which counts as stopped.
    """
    axes = (*of, of[0])[:2]
    rows = rows.select("clip_id", "frame_idx", F.col(axes[0]).cast("double").alias("m0"), (F.col(axes[1]).cast("double") if len(of) > 1 else F.lit(0.0)).alias("m1"))
    state = _wide(cut(blocks(rows, ["m0", "m1"], block=block)), Smooth.edge * 2, block)
    state = state.withColumns({"w": _same(weight(data), "m0"), "b": F.array().cast("array<double>"), "c0": _same(0, "m0"), "c1": _same(0, "m0")})
    found, rounds = _solved(state, Smooth, (weight(velocity), weight(acceleration)), robust)
    out = _exploded(found, (f"smooth_{axes[0]}", f"smooth_{axes[1]}" if len(of) > 1 else "_"))
    return (out if len(of) > 1 else out.drop("_")), rounds


def _wide(state: DataFrame, least: int, block: int | None) -> DataFrame:
    """The blocks by position instead of index, where gaps in a clip's indices leave a block less than `least` frames."""
    if state.where((F.col("size") < least) & (F.col("first") + F.col("size") < F.col("n"))).isEmpty():
        return state
    arrays = [f.name for f in state.schema if f.dataType.typeName() == "array"]
    one = state.select("clip_id", "n", "first", F.posexplode(F.arrays_zip(*arrays)).alias("at", "r"))
    one = one.select("clip_id", "n", (F.col("first") + F.col("at")).alias("place"), *(F.col(f"r.{c}") for c in arrays))
    listed = one.groupBy("clip_id", F.floor(F.col("place") / (block or BLOCK)).alias("part")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", *arrays))).alias("r"))
    return listed.select("clip_id", "part", F.col("r")[0]["place"].alias("first"), F.size("r").cast("long").alias("size"), "n", *(F.col(f"r.{c}").alias(c) for c in arrays))


def _taken_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the measured steps summed up (c) and taken off the anchors (m)."""
    for rows in batches:
        lists = [_array(rows.column(c)) for c in ("d0", "d1", "p0", "p1")]
        offsets = pa.array((lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()).astype(np.int32))
        starts, size = offsets.to_numpy()[:-1], np.diff(offsets.to_numpy())
        out = []
        for k in range(2):
            step, anchor = lists[k].flatten().to_numpy(), lists[2 + k].flatten().to_numpy()
            run = [np.cumsum(step[a : a + n]) for a, n in zip(starts.tolist(), size.tolist())]  # each block from its own start
            c = np.concatenate(run or [np.zeros(0)]) + np.repeat(rows.column(f"before{k}").to_numpy(), size)
            out += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (c, anchor - c)]
        names = ["clip_id", "first", "size", "n", "frames", "w", "b"]
        yield pa.record_batch([*map(rows.column, names), out[1], out[3], out[0], out[2]], names=[*names, "m0", "m1", "c0", "c1"])


def object_path(
    tracks: DataFrame, centre: tuple[float, float] = (480.0, 270.0), detected: float = DETECTED, weak: float = CENTRE, step: float = STEP, no_step: float = NO_STEP,
    robust: Robust | None = None, block: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Step 1: (clip_id, frame_idx, x, y) and the rounds (clip_id, round, moved, stopped) of tracks.

    tracks: clip_id, frame_idx, delta_valid, delta_x, delta_y, center_valid, center_x, center_y. A frame is drawn to its detection with sigma `detected`, or to the
    image's centre with `weak`; its step from the frame before to the measured one with `step`, or to none with `no_step`. Null flags
    count as false. The steps that were measured are taken off beforehand, so that what is solved for hardly moves.
    """
    ok, seen = F.coalesce("delta_valid", F.lit(False)), F.coalesce("center_valid", F.lit(False))
    rows = tracks.select(
        "clip_id", "frame_idx", *(F.when(ok, F.col(f"delta_{a}")).otherwise(0.0).cast("double").alias(f"d{k}") for k, a in enumerate("xy")),
        *(F.when(seen, F.col(f"center_{a}")).otherwise(centre[k]).cast("double").alias(f"p{k}") for k, a in enumerate("xy")),
        F.when(seen, weight(detected)).otherwise(weight(weak)).alias("w"), F.when(ok, weight(step)).otherwise(weight(no_step)).alias("b"),
    )
    gathered = blocks(rows, ["d0", "d1", "p0", "p1", "w", "b"], {f"before{k}": F.col(f"d{k}") for k in range(2)}, block)
    found, rounds = _solved(bounded(gathered).mapInArrow(_taken_off, _STATE), Chain, (), robust)
    return _exploded(found, ("x", "y")), rounds


def smoothed(rows: DataFrame, smoothness: float = 0.5, of: tuple[str, ...] = ("position",), robust: bool = False, delta: float = HUBER) -> DataFrame:
    """(clip_id, frame_idx, smooth_<axis> ...) of step 2 for a smoothness of 0 to 1."""
    data, motion = smoothing_sigmas(smoothness)
    return smooth(rows, motion, motion, data, of, Robust(delta) if robust else None)[0]
