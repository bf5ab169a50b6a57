"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

The vectors' second moments, summed in Spark, give the rotation that puts most of their length
into the first coordinates. Candidates are cut into blocks by descending length, and a query is sent only to
the blocks whose longest vector could still reach its k-th score among the longest of all; blocks of queries
and candidates meet in tasks of bounded size. There the candidates come by descending
length: a query ends when its length times the next one's cannot reach its k-th score; before
that, the product over the first rotated coordinates plus the product of the residual lengths rules
candidates out. What is left is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, saved
from .vectors import best, floored, matrix, pair_products

K, SCALE = 10, 1024
QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK, SEEDS = 4096, 65536, 256, 1024


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        flat = batch.column("v").flatten().to_numpy()
        ends = np.cumsum(dims)
        for d in np.unique(dims).tolist():
            x = flat[(ends[dims == d] - d)[:, None] + np.arange(d)]
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        cell = np.arange(d * d)
        yield pa.record_batch([pa.array(np.full(d * d, d, np.int32)), pa.array(cell.astype(np.int64)), pa.array(m.ravel())], names=["dim", "cell", "x"])


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions d the d x d rotation to the principal axes, longest first; d * d numbers each."""
    cells = vectors.select("dim", "v").mapInArrow(_moments, "dim int, cell long, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x"))
    found: dict[int, np.ndarray] = {}
    for r in cells.toLocalIterator():
        found.setdefault(r.dim, np.zeros(r.dim * r.dim))[r.cell] = r.x
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in found.items() if np.isfinite(m).all()}


def _reach(q_norm: np.ndarray, c_norm) -> np.ndarray:
    """The highest product that lengths allow, with the rounding of float sums; infinite where it cannot be told."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(q_norm * c_norm * (1 + 1e-9) + 1e-6, nan=np.inf, posinf=np.inf)


def _cell(k: int, turns):
    names = ["query_id", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        d = left.column("dim")[0].as_py()
        q_ids, c_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        q, c, q_norm, c_norm = matrix(left.column("v"), d), matrix(right.column("v"), d), left.column("norm").to_numpy(), right.column("norm").to_numpy()
        least = left.column("least").to_numpy(zero_copy_only=False).astype(float).copy()
        least[np.isnan(least)] = -np.inf
        by_length = np.lexsort((c_ids, -c_norm))
        c_ids, c, c_norm = c_ids[by_length], c[by_length], c_norm[by_length]
        turn, half = turns.value.get(d, np.eye(d)), max(1, d // 4)
        with np.errstate(over="ignore", invalid="ignore"):
            q_turned, c_turned = q @ turn, c @ turn
            rest = lambda x: np.sqrt((x[:, half:] ** 2).sum(1))
            q_rest, c_rest = rest(q_turned), rest(c_turned)
        held_ids, held = [np.zeros(0, np.int64)] * len(q), [np.zeros(0, np.int64)] * len(q)
        live = np.arange(len(q))
        for at in range(0, len(c), CHUNK):
            live = live[_reach(q_norm[live], c_norm[at]) >= least[live]]
            if not len(live):
                break
            stop = min(at + CHUNK, len(c))
            with np.errstate(over="ignore", invalid="ignore"):
                bound = q_turned[live, :half] @ c_turned[at:stop, :half].T + q_rest[live, None] * c_rest[None, at:stop]
                bound += 1e-9 * q_norm[live, None] * c_norm[at] + 1e-6
            i, j = np.nonzero(~(bound < least[live, None]))  # a bound that is not a number rules nothing out
            i, j = live[i], j + at
            other = q_ids[i] != c_ids[j]
            i, j = i[other], j[other]
            scores = pair_products(q[i], c[j])
            edges = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True]))) if len(i) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:]):
                n = i[a]
                ids, all_scores = np.concatenate((held_ids[n], c_ids[j[a:b]])), np.concatenate((held[n], scores[a:b]))
                top = best(ids, all_scores, k)
                held_ids[n], held[n] = ids[top], all_scores[top]
                if len(top) == k:
                    least[n] = max(least[n], float(held[n][-1]))
        out = [np.repeat(q_ids, [len(x) for x in held]), np.concatenate(held_ids), np.concatenate(held)]
        return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(names, out)})

    return run


def _seeded(k: int, seeds, longest):
    """Adds `least`, the k-th score among the longest vectors, a lower bound of the k-th score among all, and `upto`, the number of
    blocks from the first one on whose longest vector could reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = longest.value
        for batch in batches:
            least, upto = [], []
            for key, d, norm, v in zip(batch.column("vec_id").to_pylist(), batch.column("dim").to_pylist(), batch.column("norm").to_numpy(), batch.column("v")):
                ids, m = seeds.value.get(d, (np.zeros(0, np.int64), None))
                own = ids != key
                scores = np.sort(pair_products(m[own], np.broadcast_to(v.values.to_numpy(), m[own].shape))) if own.sum() >= k else None
                least.append(None if scores is None else float(scores[-k]))
                upto.append(len(norms) if scores is None else int((_reach(norm, norms) >= float(scores[-k])).sum()))
            yield pa.record_batch([*batch.columns, pa.array(least, pa.float64()), pa.array(upto, pa.int32())], names=[*batch.schema.names, "least", "upto"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = 100, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`, against all rows.

    vectors: vec_id, embedding (array of numbers); other columns are ignored. Components become floor(scale * x). Rows
    with a null id, a null or empty vector, a null component, or one that is not finite, take no part. Partners have the query's number of
    dimensions and another vec_id; rows of one vec_id count once, the repeated ones being dropped if they are equal.
    Ties go to the smaller vec_id; fewer than k partners give fewer rows. Products beyond 64 bits count as the nearest long.
    """
    rows = floored(vectors.select("vec_id", "embedding").where("vec_id is not null"), scale)
    rows = saved(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    context, n = rows.sparkSession.sparkContext, rows.count()
    turns = context.broadcast(rotations(rows))
    n_c = max(min(context.defaultParallelism, -(-n // CHUNK)), -(-n // CANDIDATE_BLOCK), 1)
    blocks = saved(rows.repartitionByRange(n_c, F.desc("norm"), "vec_id").withColumn("cb", F.spark_partition_id()), "blocks")
    ends = {r.cb: r.norm for r in blocks.groupBy("cb").agg(F.max("norm").alias("norm")).collect()}  # a number for each block
    longest = np.array([ends.get(b, 0.0) for b in range(max(ends, default=-1) + 1)])
    longest = np.maximum.accumulate(longest[::-1])[::-1]  # an empty block counts as the next one
    longest = context.broadcast(longest)
    of: dict[int, list] = {}
    for r in rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect():
        of.setdefault(r.dim, []).append(r)
    seeds = context.broadcast({d: (np.array([r.vec_id for r in x]), np.array([r.v for r in x])) for d, x in of.items()})
    columns = "vec_id long, dim int, norm double, v array<double>, least double, upto int"
    queries = saved(rows.where(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(_seeded(k, seeds, longest), columns), "queries")
    n_q = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int"))
    left = queries.where("upto > 0").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)))
    needed = queries.groupBy("qb").agg(F.max("upto").alias("most"))  # a row for each block of queries
    right = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(F.broadcast(needed), "qb").where("cb < most").drop("most")
    cells = left.drop("upto").groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(_cell(k, turns), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = saved(cells.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    for spread in (turns, longest, seeds):
        spread.unpersist()
    discard(rows, blocks, queries)
    return out


SQL = """
with parts as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from parts q join parts c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score
from scored
window w as (partition by query_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""
