"""Results of a stream handed to several receivers, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def fan_out(stream: DataFrame, receivers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, finished: Callable[[], None] | None = None) -> StreamingQuery:
    """Starts a query that gives every batch to all receivers in order of their names, and calls `finished` when what there is has been read.

    The batch is computed once for all of them. A batch that is run again after a failure has the same id, by which receivers that
    write can replace what they wrote.
    """

    def give(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for name in sorted(receivers):
                receivers[name](kept, batch_id)
        finally:
            kept.unpersist()

    query = stream.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if finished:
        query.awaitTermination()
        finished()
    return query
