"""Streaming forms of the throttle and of the keep-latest cache, with the batch operators' results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequence import ran


def throttle_stream(frames: DataFrame, gap: int = 15, success: str | None = None) -> DataFrame:
    """The frames (clip_id, frame_idx) that run, for a stream in frame order; the last index that succeeded is the state."""
    frames = frames.withColumn("_ok", F.coalesce(F.col(success), F.lit(False)) if success else F.lit(True))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).groupby("frame_idx")["_ok"].max()
        last = state.get[0] if state.exists else None
        picked, last = ran(rows.index.to_numpy(), rows.to_numpy(bool), gap, last)
        if last is not None:
            state.update((int(last),))
        index = rows.index.to_numpy()[picked]
        yield pd.DataFrame({"clip_id": [key[0]] * len(index), "frame_idx": pd.Series(index, dtype="int32")})

    return frames.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, frame_idx int", "last int", "append", GroupStateTimeout.NoTimeout)


def latest_stream(frames: DataFrame, cap: int) -> DataFrame:
    """Updates (clip_id, n, oldest, newest) of a cache of the latest `cap` frames of every clip."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = set(state.get[0]) if state.exists else set()
        kept = sorted(kept | set(pd.concat(list(parts))["frame_idx"].tolist()))[-cap:]
        state.update((kept,))
        yield pd.DataFrame({"clip_id": [key[0]], "n": [len(kept)], "oldest": [kept[0]], "newest": [kept[-1]]})

    return frames.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, n int, oldest int, newest int", "kept array<int>", "update", GroupStateTimeout.NoTimeout)
