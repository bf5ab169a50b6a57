"""Vectors of integers held as doubles: reading, exact products, and blocks of rows for the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below this, sums of products of integer doubles are exact.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _floored(scale: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            ends = np.cumsum(lengths)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))  # nulls are NaN here
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * values) + 0.0  # no negative zero
            beyond = np.concatenate(([0], np.cumsum(~np.isfinite(whole))))
            good = np.array(vectors.is_valid()) & (lengths > 0) & (bad[ends] == bad[ends - lengths]) & (beyond[ends] == beyond[ends - lengths])
            keep = np.flatnonzero(good)
            rows = [whole[ends[i] - lengths[i] : ends[i]] for i in keep]
            most = [max(1.0, np.abs(x).max()) for x in rows]
            norms = [float(m * np.sqrt(((x / m) ** 2).sum())) for x, m in zip(rows, most)]
            take = pa.array(keep)
            yield pa.record_batch(
                [*(batch.column(n).take(take) for n in names), pa.array(lengths[keep].astype(np.int32)), pa.array(norms, pa.float64()), pa.array(rows, pa.list_(pa.float64()))],
                names=[*names, "dim", "norm", "v"],
            )

    return run


def floored(rows: DataFrame, scale: int) -> DataFrame:
    """rows (embedding and others) -> the others, dim, norm and v, the components as floor(scale * x), in doubles.

    Rows whose vector is null or empty, or has a null component or one that is not finite (before or after the scaling), are left out.
    """
    others = [f for f in rows.schema if f.name != "embedding"]
    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in others) + "dim int, norm double, v array<double>"
    return rows.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(_floored(scale, [f.name for f in others]), schema)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(y) for y in x.ravel()], object).reshape(x.shape)


def pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a[i] and b[i], exact, as longs; what is beyond 64 bits becomes the nearest long."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    # |a| |b| bounds a product and each of its partial sums
    with np.errstate(over="ignore", invalid="ignore"):
        wide = np.flatnonzero(~(np.abs(a) * np.abs(b)).sum(1).__lt__(EXACT))
        out = np.einsum("ij,ij->i", a, b)
    out[wide] = 0
    out = out.astype(np.int64)
    for i in wide.tolist():
        out[i] = max(-LONG, min(LONG, int((_whole(a[i]) * _whole(b[i])).sum())))
    return out


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, d)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]
