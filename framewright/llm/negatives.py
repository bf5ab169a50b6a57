"""Hard negatives by a vector-approximation file.

Each component of a vector is quantised into one of 256 cells; a row's approximation is a byte a component. Anchors and
rows are dealt in blocks, and every block of anchors meets every block of rows in one task. There tables of the cells' ends give
a lower and an upper bound of every score. Only rows whose bounds may reach an anchor's window, and the places left
in it, are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, saved
from .vectors import best, floored, pair_products

SCALE, CELLS = 256, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score times 100 is within these parts of the positive's score.
LEAST, MOST = 50, 95
#: Rows whose components set the cells' edges, by a hash of their ids; bounds hold whatever the edges.
SAMPLE = 4096
ANCHOR_BLOCK, ROW_BLOCK, CHUNK = 2048, 131_072, 2048


class Cells(NamedTuple):
    """Of vectors of one length: inner edges, and each cell's least and largest value, a row a component."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        dims, flat = batch.column("dim").to_numpy(), batch.column("v").flatten().to_numpy()
        ends = np.cumsum(dims)
        for d in np.unique(dims).tolist():
            x = flat[(ends[dims == d] - d)[:, None] + np.arange(d)]
            low, high = found.get(d, (x[0], x[0]))
            found[d] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
    for d, (low, high) in found.items():
        yield pa.record_batch([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high)], names=["dim", "place", "low", "high"])


def fit_cells(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> dict[int, Cells]:
    """Cells for each length of vector; edges at the quantiles of a sample of at most `sample` rows, ends from all rows.

    The driver gets two numbers for each component, and the sample.
    """
    ends = rows.select("dim", "v").mapInArrow(_ranges, "dim int, place int, low double, high double").groupBy("dim", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = ends.orderBy("dim", "place").toPandas()
    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "v").limit(sample).collect():
        drawn.setdefault(r.dim, []).append(r.v)
    out = {}
    for d, own in ends.groupby("dim"):
        low, high = own["low"].to_numpy(), own["high"].to_numpy()
        at = np.linspace(0, 1, cells + 1)[1:-1]
        edges = np.ceil(np.quantile(np.array(drawn[d]), at, axis=0).T if d in drawn else low[:, None] + (high / 2 - low / 2)[:, None] * 2 * at)
        first, last = low[:, None], high[:, None]
        below = np.concatenate((first, np.maximum(edges, first)), 1)
        above = np.concatenate((np.minimum(edges - 1, last), last), 1)
        out[int(d)] = Cells(edges, below, np.maximum(above, below))
    return out


def _approximated(cells):
    """v -> codes, a byte a component, beside v in the smallest type that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, exact = [], []
            dims, flat = batch.column("dim").to_pylist(), batch.column("v").flatten().to_numpy()
            at = 0
            for d in dims:
                x = flat[at : at + d]
                at += d
                edges = cells.value[d].edges
                codes.append((edges <= x[:, None]).sum(1).astype(np.uint8).tobytes())
                exact.append((x.astype(np.int16) if np.abs(x).max() < 32768 else x).tobytes())
            names = [n for n in batch.schema.names if n != "v"]
            yield pa.record_batch([*map(batch.column, names), pa.array(codes, pa.binary()), pa.array(exact, pa.binary())], names=[*names, "codes", "exact"])

    return run


def _codes(table: pa.Table, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, d)


def _exact(table: pa.Table, d: int) -> np.ndarray:
    rows = table.column("exact").to_pylist()
    if all(len(x) == 2 * d for x in rows):
        return np.frombuffer(b"".join(rows), np.int16).reshape(-1, d).astype(float)
    return np.array([np.frombuffer(x, np.int16 if len(x) == 2 * d else float).astype(float) for x in rows])


class _Bounds:
    """Bounds of the scores of some anchors with chunks of rows, by the cells' ends."""

    def __init__(self, cells: Cells, anchors: np.ndarray):
        self.cells, self.plus, self.minus = cells, np.maximum(anchors, 0), np.minimum(anchors, 0)
        self.place = np.arange(anchors.shape[1])
        with np.errstate(over="ignore"):
            self.size = np.abs(anchors).sum(1)

    def __call__(self, own: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.cells.low[self.place, codes], self.cells.high[self.place, codes]
        with np.errstate(over="ignore", invalid="ignore"):
            lower = self.plus[own] @ low.T + self.minus[own] @ high.T
            upper = self.plus[own] @ high.T + self.minus[own] @ low.T
            most = self.size[own] * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
            slack = np.where(most < 2.0**53, 0.0, 1e-10 * most)[:, None]  # below, the sums are exact
            return np.nan_to_num(lower - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(upper + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _empty(names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([], pa.int64()) for n in names})


def _top_positives(cells, k: int):
    names = ["anchor_id", "sign", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(names)
        d = left.column("dim")[0].as_py()
        a_ids, a_labels, anchors = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), _exact(left, d)
        ids, labels, codes, vectors = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), _codes(right, d), _exact(right, d)
        bounds, kept = _Bounds(cells.value[d], anchors), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(anchors)
        least = np.full(len(anchors), -np.inf)
        for label in np.unique(a_labels).tolist():
            own, rows = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
            for at in range(0, len(rows), CHUNK):
                chunk = rows[at : at + CHUNK]
                lower, upper = bounds(own, codes[chunk])
                itself = a_ids[own][:, None] == ids[chunk][None, :]
                lower[itself], upper[itself] = -np.inf, -np.inf
                if len(chunk) >= k:
                    least[own] = np.maximum(least[own], np.partition(lower, len(chunk) - k, axis=1)[:, len(chunk) - k])
                open_ = (upper >= least[own][:, None]) & ~itself
                for i in np.flatnonzero(open_.any(1)).tolist():
                    n, pick = own[i], chunk[open_[i]]
                    scores = pair_products(np.broadcast_to(anchors[n], (len(pick), d)), vectors[pick])
                    all_ids, all_scores = np.concatenate((kept[n][0], ids[pick])), np.concatenate((kept[n][1], scores))
                    top = best(all_ids, all_scores, k)
                    kept[n] = all_ids[top], all_scores[top]
                    if len(top) == k:
                        least[n] = max(least[n], float(all_scores[top[-1]]))
        sizes = [len(x[0]) for x in kept]
        columns = [np.repeat(a_ids, sizes), np.repeat(left.column("sign").to_numpy(), sizes), *(np.concatenate([x[j] for x in kept]) for j in range(2))]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, columns)})

    return run


def _windows(scores: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest score of a negative for positives of these scores: least * p <= 100 n <= most * p."""
    whole = [int(x) for x in scores]
    return np.array([-(-least * x // 100) for x in whole], float), np.array([most * x // 100 for x in whole], float)


def _top_negatives(cells, k: int, least: int, most: int):
    names = ["anchor_id", "sign", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(names)
        d = left.column("dim")[0].as_py()
        a_ids, a_labels, signs, anchors = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), left.column("sign").to_numpy(), _exact(left, d)
        ids, labels, codes, vectors = right.column("vec_id").to_numpy(), right.column("label").to_numpy(), _codes(right, d), _exact(right, d)
        bounds = _Bounds(cells.value[d], anchors)
        positives = [[(x["id"], x["score"]) for x in p] for p in left.column("positives").to_pylist()]
        ends = [_windows(np.array([s for _, s in p], object), least, most) for p in positives]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept = [[none] * len(p) for p in positives]
        reach = [[-np.inf] * len(p) for p in positives]
        low, high = np.array([e[0].min() for e in ends])[:, None], np.array([e[1].max() for e in ends])[:, None]
        everyone = np.arange(len(anchors))
        for at in range(0, len(ids), CHUNK):
            chunk = np.arange(at, min(at + CHUNK, len(ids)))
            lower, upper = bounds(everyone, codes[chunk])
            open_ = (upper >= low) & (lower <= high) & (labels[chunk][None, :] != a_labels[:, None]) & (ids[chunk][None, :] != a_ids[:, None])
            for n in np.flatnonzero(open_.any(1)).tolist():
                pick = np.flatnonzero(open_[n])
                lo, hi = lower[n, pick], upper[n, pick]
                wanted = np.zeros(len(pick), bool)
                for j, (first, last) in enumerate(zip(*ends[n])):
                    sure = lo[(lo >= first) & (hi <= last)]
                    if len(sure) >= k:
                        reach[n][j] = max(reach[n][j], float(np.partition(sure, len(sure) - k)[len(sure) - k]))
                    wanted |= (hi >= max(first, reach[n][j])) & (lo <= last)
                pick = chunk[pick[wanted]]
                if not len(pick):
                    continue
                scores = pair_products(np.broadcast_to(anchors[n], (len(pick), d)), vectors[pick])
                for j, (first, last) in enumerate(zip(*ends[n])):
                    inside = (scores >= first) & (scores <= last)
                    if inside.any():
                        all_ids, all_scores = np.concatenate((kept[n][j][0], ids[pick[inside]])), np.concatenate((kept[n][j][1], scores[inside]))
                        top = best(all_ids, all_scores, k)
                        kept[n][j] = all_ids[top], all_scores[top]
                        if len(top) == k:
                            reach[n][j] = max(reach[n][j], float(all_scores[top[-1]]))
        out = [(a_ids[n], signs[n], *positives[n][j], i, s) for n in range(len(anchors)) for j in range(len(positives[n])) for i, s in zip(*kept[n][j])]
        return pa.table({n: pa.array([int(r[c]) for r in out], pa.int64()) for c, n in enumerate(names)})

    return run


def _met(anchors: DataFrame, rows: DataFrame, n_a: int, n_r: int, cell, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows of vectors as long, one task a pair."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("ab", F.pmod(F.xxhash64("vec_id"), F.lit(n_a)).cast("int")).withColumn("rb", spread(n_r))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_r)).cast("int")).withColumn("ab", spread(n_a))
    return left.groupBy("dim", "ab", "rb").cogroup(right.groupBy("dim", "ab", "rb")).applyInArrow(cell, schema)


def mine(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose vec_id is divisible by `every`.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored. Components become floor(scale * x). Rows with a
    null id or label, a null or empty vector, a null component or one that is not finite, take no part. Scores are integer inner products,
    higher ones first, ties by smaller vec_id. An anchor's positives are the first `positives` rows of its label, its negatives those of other labels with
    least * positive_score <= 100 * negative_score <= most * positive_score, of which the first `negatives` are returned for each
    positive. An anchor meets rows of other vec_ids, and of its own number of dimensions. Equal rows count once; an anchor
    whose id has several vectors or labels has a result for each. Scores beyond 64 bits count as the nearest long. Empty tables, and labels
    of one row, give no rows.
    """
    rows = floored(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where("vec_id is not null and label is not null"), scale)
    rows = saved(rows.drop("norm").dropDuplicates(["vec_id", "label", "v"]), "vectors")
    context = rows.sparkSession.sparkContext
    cells = context.broadcast(fit_cells(rows))  # 2 * 256 numbers a component
    file = saved(rows.mapInArrow(_approximated(cells), "vec_id long, label long, dim int, codes binary, exact binary"), "approximations")
    anchors = saved(file.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("sign", F.xxhash64("label", "exact")), "anchors")
    n_a = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    n_r = max(1, min(context.defaultParallelism, file.count() // CHUNK), -(-file.count() // ROW_BLOCK))
    found = _met(anchors, file, n_a, n_r, _top_positives(cells, positives), "anchor_id long, sign long, vec_id long, score long")
    first = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = found.withColumn("n", first(("anchor_id", "sign"), F.desc("score"), "vec_id")).where(F.col("n") <= positives)
    listed = top.where("score >= 0").groupBy(F.col("anchor_id").alias("a_id"), F.col("sign").alias("a_sign")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("positives"))
    ready = saved(anchors.join(listed, (F.col("vec_id") == F.col("a_id")) & (F.col("sign") == F.col("a_sign"))).drop("a_id", "a_sign"), "positives")
    met = _met(ready, file, n_a, n_r, _top_negatives(cells, negatives, least, most), "anchor_id long, sign long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = first(("anchor_id", "sign", "positive_id"), F.desc("negative_score"), "negative_id")
    out = met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    out = saved(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    cells.unpersist()
    discard(rows, file, anchors, ready)
    return out


def relabelled(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows with the label (label + 1) % labels where vec_id is divisible by `every`."""
    return embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).alias("label"))


SQL = f"""
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, cast(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from rows a join rows r on a.vec_id <> r.vec_id and len(a.v) = len(r.v) where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}
), ranked as (
  select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
  from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  where {LEAST} * positive_score <= 100 * score and 100 * score <= {MOST} * positive_score
)
select * from ranked where rank <= {NEGATIVES}
"""
