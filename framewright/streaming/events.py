"""What runs tell of themselves, appended to a table of events: counts and sums of batch jobs, progress of streaming queries."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = "at double, run string, kind string, name string, value double"


def append(spark: SparkSession, path: str, run: str, kind: str, values: dict[str, float | None]) -> None:
    """A row for each value, in one append."""
    if values:
        now = time.time()
        rows = [(now, run, kind, name, None if value is None else float(value)) for name, value in sorted(values.items())]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


class Watch:
    """Metrics of a DataFrame that Spark takes while an action runs over it: no second pass.

    watch = Watch("export", rows, n=F.count("*")); watch.rows is written or counted, then watch.record(path) appends what was seen.
    """

    def __init__(self, run: str, rows: DataFrame, **metrics: Column):
        self.run, self.spark, self.began = run, rows.sparkSession, time.time()
        self.observation = Observation(run)
        self.rows = rows.observe(self.observation, *(c.alias(n) for n, c in metrics.items()))

    def record(self, path: str, kind: str = "batch") -> dict[str, float | None]:
        """Waits for the action, and adds the seconds since the watch began."""
        values = dict(self.observation.get) | {"seconds": time.time() - self.began}
        append(self.spark, path, self.run, kind, values)
        return values


class ProgressTable(StreamingQueryListener):
    """Keeps each batch's progress of all queries; `flush` appends it to the table.

    A listener must not run jobs while Spark waits for it, so rows are held until flush, at most a few numbers a batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.held = spark, path, []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.held.append((str(event.id), "started", {}))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        took = {f"{k}_ms": v for k, v in p.get("durationMs", {}).items()}
        observed = {f"{name}.{k}": v for name, row in (p.get("observedMetrics") or {}).items() for k, v in row.items() if isinstance(v, (int, float))}
        self.held.append((p["id"], "progress", {"batch": p["batchId"], "rows": p["numInputRows"], **took, **observed}))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.held.append((str(event.id), "failed" if event.exception else "ended", {"failed": 1.0 if event.exception else 0.0}))

    def flush(self) -> int:
        """Appends what is held; the number of events."""
        held, self.held = self.held, []
        for run, kind, values in held:
            append(self.spark, self.path, run, kind, values)
        return len(held)


def summary(events: DataFrame) -> DataFrame:
    """(run, kind, name, n, total, last) of an event table."""
    last = F.max(F.struct("at", "value"))["value"]
    return events.groupBy("run", "kind", "name").agg(F.count("value").alias("n"), F.sum("value").alias("total"), last.alias("last"))
