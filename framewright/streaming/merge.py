"""Streams of a clip that wait for one another: the ordered merge of two packet streams, and the barrier of frames and results.

Both keep their waiting rows in state, in the order they came; a query that is restarted from its checkpoint goes on where it was. They need the
RocksDB state store: `with_state_store(spark)` sets it where the session has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Merge(StatefulProcessor):
    """Packets wait in a list for each input; `counts` holds the next position and which inputs have ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = [handle.getListState(name, "ts_us long, pkt_id long") for name in ("video", "audio")]
        self.counts = handle.getValueState("counts", "position long, video_ended boolean, audio_ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        position, *ended = self.counts.get() if self.counts.exists() else (0, False, False)
        lines = [list(s.get()) for s in self.waiting]
        for part in rows:
            for rank, ts, pkt in zip(part["stream_rank"], part["ts_us"], part["pkt_id"]):
                if pd.isna(pkt):
                    ended[int(rank)] = True
                else:
                    lines[int(rank)].append((int(ts), int(pkt)))
        for line in lines:
            line.sort()  # a batch's rows may come in any order; an input's batches come in order
        out, at = [], [0, 0]
        while True:
            left = [len(lines[k]) - at[k] for k in (0, 1)]
            if left[0] and left[1]:
                rank = 0 if lines[0][at[0]][0] <= lines[1][at[1]][0] else 1  # video first on ties
            elif left[0] and ended[1] or left[1] and ended[0]:
                rank = 0 if left[0] else 1
            else:
                break
            ts, pkt = lines[rank][at[rank]]
            out.append((key[0], pkt, rank, ts, position))
            at[rank], position = at[rank] + 1, position + 1
        for state, line, n in zip(self.waiting, lines, at):
            if line[n:]:
                state.put(line[n:])
            else:
                state.clear()
        self.counts.update((position, bool(ended[0]), bool(ended[1])))
        yield pd.DataFrame(out, columns=["clip_id", "pkt_id", "stream_rank", "ts_us", "position"]).astype({"clip_id": "int64", "pkt_id": "int64", "stream_rank": "int32", "ts_us": "int64", "position": "int64"})

    def close(self) -> None:
        pass


def merged(packets: DataFrame) -> DataFrame:
    """(clip_id, pkt_id, stream_rank, ts_us, position) of a stream of packets (clip_id, stream_rank, ts_us, pkt_id) in writing order.

    stream_rank: 0 video, 1 audio; each input's stamps do not fall from batch to batch. A packet goes out once the other input has one that is not earlier, video first
    on equal stamps. A row with a null pkt_id says that its input has ended, after which the other one's packets no longer wait.
    """
    rows = packets.select("clip_id", F.col("stream_rank").cast("int").alias("stream_rank"), F.col("ts_us").cast("long").alias("ts_us"), F.col("pkt_id").cast("long").alias("pkt_id"))
    return rows.groupBy("clip_id").transformWithStateInPandas(_Merge(), "clip_id long, pkt_id long, stream_rank int, ts_us long, position long", "Append", "None")


class _Barrier(StatefulProcessor):
    """Frames wait for the processed index; results are kept until their frame has passed. A timer lets go of frames that wait too long."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "frame_idx long")
        self.results = handle.getMapState("results", "frame_idx long", "done_at long")
        self.passed = handle.getMapState("passed", "frame_idx long", "passed_at long")
        self.index = handle.getValueState("processed", "frame_idx long")

    def _frame(self, clip, frame, seq):
        done = self.results.getValue((frame,))[0] if self.results.containsKey((frame,)) else None
        if done is not None:
            self.results.removeKey((frame,))
        self.passed.updateValue((frame,), (seq,))
        return clip, frame, "frame", seq, done is not None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting, index = [r[0] for r in self.frames.get()], self.index.get()[0] if self.index.exists() else -1
        part = pd.concat(list(rows)).assign(_order=lambda r: r["kind"].map({"result": 0, "processed": 1, "frame": 2})).sort_values(["seq", "_order", "frame_idx"])
        out = []
        for kind, frame, seq in zip(part["kind"], part["frame_idx"], part["seq"]):
            frame, seq = int(frame), int(seq)
            if kind == "result":
                if self.passed.containsKey((frame,)):
                    out.append((key[0], frame, "late", seq, False))
                elif not self.results.containsKey((frame,)):
                    self.results.updateValue((frame,), (seq,))
            elif kind == "processed":
                index = max(index, frame)
                out += [self._frame(key[0], f, seq) for f in sorted(f for f in waiting if f <= index)]
                waiting = [f for f in waiting if f > index]
            elif frame <= index:
                out.append(self._frame(key[0], frame, seq))
            else:
                waiting.append(frame)
        self.frames.put([(f,) for f in waiting]) if waiting else self.frames.clear()
        if index >= 0:
            self.index.update((index,))
        if self.patience is not None and waiting:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = [(key[0], r[0], "frame", None, False) for r in self.frames.get()]
        for r in out:
            self.passed.updateValue((r[1],), (-1,))
        self.frames.clear()
        yield self._out(out)

    @staticmethod
    def _out(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["clip_id", "frame_idx", "kind", "at", "used"]).astype({"clip_id": "int64", "frame_idx": "int64", "kind": "object", "at": "Int64", "used": "bool"})

    def close(self) -> None:
        pass


def barrier_stream(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """(clip_id, frame_idx, kind, at, used) of a stream of events (clip_id, kind, frame_idx, seq), which come in order of seq.

    kind: `frame`, a frame that waits until an index as high as its own is processed; `processed`; `result`, a result that is there. Out come the frames, with the seq
    at which they pass and whether their result was there, and results that came after their frame had passed, as `late`. Of one seq, results come first,
    then processed indices. With patience_ms, frames that wait longer go on without a result, at a null seq.
    """
    rows = events.select("clip_id", "kind", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("clip_id").transformWithStateInPandas(_Barrier(patience_ms), "clip_id long, frame_idx long, kind string, at long, used boolean", "Append", "None" if patience_ms is None else "ProcessingTime")


def write_barrier(events: DataFrame, frames_path: str, late_path: str, checkpoint: str, patience_ms: int | None = None) -> StreamingQuery:
    """Starts a query that writes passed frames and late results to a table each; a batch that is run again replaces what it wrote."""
    from .fanout import fan_out

    def to(path: str, kind: str):
        return lambda batch, batch_id: batch.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fan_out(barrier_stream(events, patience_ms), {"frames": to(frames_path, "frame"), "late": to(late_path, "late")}, checkpoint)
