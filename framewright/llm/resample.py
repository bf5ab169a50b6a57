"""Importance resampling towards a target distribution over bucket-partitioned inverted postings.

Documents and target texts are indexed by segments: for a slice of texts and each block of buckets, one row with
the (bucket, text, count) postings of the slice. These rows are shuffled by block, so that both corpora's postings of a
bucket meet there; a block is dealt over lots of segments, and only its sums of counts are brought together. They give
each bucket's gain; the postings of the block turn it into contributions, which are reduced by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded, discard, saved, unused
from .textarrays import Words, slices

BUCKETS, GRAMS = 10_000, 3
#: Buckets of one block: their numbers in the block, and the gaps between them, fit a byte.
BLOCK = 250
#: Lots that the segments of a block are dealt over: a block with most postings is no single task.
LOTS = 64
PERCENT, LEAST_WORDS, SEED = 5, 20, 42

U32 = np.uint32
#: Words whose zero-shift has a table of its own; longer ones are rare and take one made for their length.
_TABLED = 66


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32, reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=U32)
    for _ in range(8):
        t = np.where(t & U32(1), (t >> U32(1)) ^ U32(0xEDB88320), t >> U32(1))
    return t


_CRC = _crc_table()


def _zero_byte(x: np.ndarray) -> np.ndarray:
    return _CRC[x & U32(255)] ^ (x >> U32(8))


def _shift_tables(n: int) -> np.ndarray:
    """[length, byte of the register, value of that byte] -> the register after so many zero bytes; it is linear."""
    t = np.zeros((n, 4, 256), U32)
    t[0] = np.arange(256, dtype=U32)[None, :] << (U32(8) * np.arange(4, dtype=U32))[:, None]
    for i in range(1, n):
        t[i] = _zero_byte(t[i - 1])
    return t


_SHIFTS = _shift_tables(_TABLED)


def _zeros(x: np.ndarray, n: int) -> np.ndarray:
    """The registers x after n zero bytes, by squaring the step."""
    step = _SHIFTS[1]
    apply = lambda t, v: t[0][v & U32(255)] ^ t[1][(v >> U32(8)) & U32(255)] ^ t[2][(v >> U32(16)) & U32(255)] ^ t[3][v >> U32(24)]
    while n:
        if n & 1:
            x = apply(step, x)
        step, n = apply(step, step), n >> 1
    return x


def _shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The registers x[i] after n[i] zero bytes."""
    at = np.minimum(n, _TABLED - 1)
    flat = _SHIFTS.reshape(-1)
    base = at * 1024
    out = flat[base + (x & U32(255))] ^ flat[base + 256 + ((x >> U32(8)) & U32(255))] ^ flat[base + 512 + ((x >> U32(16)) & U32(255))] ^ flat[base + 768 + (x >> U32(24))]
    far = np.flatnonzero(n >= _TABLED)
    for m in np.unique(n[far]).tolist():
        own = far[n[far] == m]
        out[own] = _zeros(x[own], m)
    return out


def _word_registers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC registers of the words, from 0: byte after byte over all words that long, longest first."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    reg = np.zeros(len(order), U32)
    most = int(left[0]) if len(left) else 0
    n_longer = np.searchsorted(-left, -np.arange(min(most, _TABLED)), "left")  # words longer than k
    for k, n in enumerate(n_longer.tolist()):
        reg[:n] = _CRC[(reg[:n] ^ data[at[:n] + k]) & U32(255)] ^ (reg[:n] >> U32(8))
    for i in range(int(np.searchsorted(-left, -_TABLED, "left"))):
        word = data[at[i] : at[i] + left[i]].tobytes()
        reg[i] = zlib.crc32(word) ^ zlib.crc32(bytes(int(left[i])))
    out = np.zeros(len(order), U32)
    out[order] = reg
    return out


def feature_hashes(data: np.ndarray, words: Words, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(text, crc32) of every run of 1 to `grams` words joined by one space; data with A-Z lower-cased.

    The CRC of a run is put together from its words' registers: register(a + b) = register(a) after len(b) zero bytes ^ register(b).
    """
    size = words.end - words.start
    reg = _word_registers(data, words.start, size)
    spaced = _shifted(np.full(len(size), _CRC[32], U32), size) ^ reg
    row = np.repeat(np.arange(len(words.row_at) - 1), words.count())
    rows, hashes, run, length = [], [], reg, size
    for k in range(grams):
        if k:
            n = max(0, len(reg) - k)
            run = _shifted(run[:n], size[k : k + n] + 1) ^ spaced[k : k + n]
            length = length[:n] + 1 + size[k : k + n]
        inside = row[: len(run)] == row[k : k + len(run)]
        rows.append(row[: len(run)][inside])
        hashes.append(run[inside] ^ _ones(length[inside]))
    return np.concatenate(rows), np.concatenate(hashes)


def _ones(n: np.ndarray) -> np.ndarray:
    """crc32 of n zero bytes: what the register's first and last inversion add to a text of n bytes."""
    return _shifted(np.full(len(n), 0xFFFFFFFF, U32), n) ^ U32(0xFFFFFFFF)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _packed(lengths: np.ndarray, gaps: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(lengths)).tobytes() + lengths.astype(np.uint32).tobytes() + gaps.tobytes() + counts.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each posting, bucket in its block, count), and the number of texts."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:4].view(np.uint32)[0])
    lengths = raw[4 : 4 + 4 * n].copy().view(np.uint32).astype(np.int64)
    m = int(lengths.sum())
    gaps, counts = raw[4 + 4 * n : 4 + 4 * n + m].astype(np.int64), raw[4 + 4 * n + m :].astype(np.int64)
    text = np.repeat(np.arange(n), lengths)
    run = np.cumsum(gaps)
    first = np.cumsum(lengths) - lengths
    before = np.where(first > 0, run[np.maximum(first - 1, 0)] if m else 0, 0)
    return text, run - before[text] if m else run, counts, n


_INDEX = "target boolean, block int, segment long, postings binary, doc_ids array<long>, n_features array<long>, n_words array<long>"


def _index(target: bool, buckets: int, grams: int):
    """Rows of _INDEX: the postings of each slice of texts by block; the first block's row also lists the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        blocks = -(-buckets // BLOCK)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, "alnum")
                row, crc = feature_hashes(_LOWER[data], words, grams)
                key, count = np.unique(row * buckets + (crc % U32(buckets)).astype(np.int64), return_counts=True)
                parts = -(-count // 255)  # a count above a byte is told by several postings
                key = np.repeat(key, parts)
                left = np.repeat(count - 255 * (parts - 1), parts)
                last = np.cumsum(parts) - 1
                count = np.where(np.isin(np.arange(len(key)), last), left, 255) if len(key) != len(count) else count
                row, bucket = key // buckets, key % buckets
                block = bucket // BLOCK
                inner = bucket - block * BLOCK
                same = np.concatenate(([False], (row[1:] == row[:-1]) & (block[1:] == block[:-1])))
                gap = np.where(same, inner - np.concatenate(([0], inner[:-1])), inner).astype(np.uint8)
                order = np.argsort(block, kind="stable")
                cut = np.searchsorted(block[order], np.arange(blocks + 1))
                payloads = []
                for k in range(blocks):
                    own = order[cut[k] : cut[k + 1]]
                    payloads.append(_packed(np.bincount(row[own], minlength=b - a), gap[own], count[own].astype(np.uint8)))
                n_words = words.count()
                n_features = sum(np.maximum(n_words - k, 0) for k in range(grams))
                first = lambda values, kind: pa.array([values, *[None] * (blocks - 1)], pa.list_(kind))
                yield pa.record_batch(
                    [
                        pa.array([target] * blocks), pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, segment)), pa.array(payloads, pa.binary()),
                        first(ids.slice(a, b - a).to_pylist(), pa.int64()), first(n_features, pa.int64()), first(n_words, pa.int64()),
                    ],
                    names=["target", "block", "segment", "postings", "doc_ids", "n_features", "n_words"],
                )
                segment += 1

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket and corpus in the postings of this task: as many rows as buckets at most, for each corpus."""
    total: dict[tuple[bool, int], np.ndarray] = {}
    for batch in batches:
        for target, block, blob in zip(batch.column("target").to_pylist(), batch.column("block").to_pylist(), batch.column("postings")):
            _, inner, count, _ = _unpacked(blob.as_py())
            total[target, block] = total.get((target, block), 0) + np.bincount(inner, count, BLOCK).astype(np.int64)
    for (target, block), n in total.items():
        own = np.flatnonzero(n)
        yield pa.record_batch([pa.array([target] * len(own), pa.bool_()), pa.array(own + block * BLOCK), pa.array(n[own])], names=["target", "bucket", "n"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for blob, gains in zip(batch.column("postings"), batch.column("gains")):
            text, inner, count, n = _unpacked(blob.as_py())
            gain = gains.values.to_numpy(zero_copy_only=False)[inner]
            part = np.zeros(n, np.int64)
            np.add.at(part, text, gain * count)
            sums.append(part)
        names = ["segment", "doc_ids", "n_features", "n_words"]
        yield pa.record_batch([*map(batch.column, names), pa.array(sums, pa.list_(pa.int64()))], names=[*names, "parts"])


def _reduced(rows: pa.Table) -> pa.Table:
    """One segment: a row for each block. The sums of each text's contributions beside its id and counts."""
    parts = rows.column("parts").combine_chunks()
    weight = parts.flatten().to_numpy().reshape(len(parts), -1).sum(0) if len(parts.flatten()) else np.zeros(0, np.int64)
    listed = {c: rows.column(c).drop_null().combine_chunks().flatten() for c in ("doc_ids", "n_features", "n_words")}
    return pa.table({"doc_id": listed["doc_ids"], "n_features": listed["n_features"], "n_words": listed["n_words"], "weight": pa.array(weight)})


def gains(postings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """postings (target, block, postings) -> bucket, gain: floor(1000 ln of the target's smoothed rate over the documents')."""
    sums = postings.select("target", "block", "postings").mapInArrow(_sums, "target boolean, bucket long, n long")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    held = saved(sums.groupBy("bucket").agg(count(F.col("target")).alias("t"), count(~F.col("target")).alias("s")), "sums")
    spark = postings.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "b").join(held, F.col("b") == F.col("bucket"), "left").select("b", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("t", F.lit(0.0)).alias("t"))
    whole = held.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return every.crossJoin(F.broadcast(whole)).select(F.col("b").alias("bucket"), F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_features, n_words, weight), one row for each row of docs.

    docs: doc_id, text; target: text; other columns are ignored. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; features
    all runs of 1 to `grams` words, repeats counted. Null and wordless texts have none and weigh 0. Repeated rows and
    null ids are rows like others. An empty table of either kind has no features. Buckets are at most 64,000 or so: the gains are
    the only thing that is broadcast, 8 bytes each.
    """
    bounded(docs.sparkSession)
    texts = lambda df, key, is_target: df.select(key.cast("long").alias("doc_id"), "text").mapInArrow(_index(is_target, buckets, grams), _INDEX)
    both = texts(docs, F.col("doc_id"), False).unionAll(texts(target, F.lit(None), True))
    lot = F.pmod(F.xxhash64("segment", "target"), F.lit(LOTS))
    postings = saved(both.repartition(F.col("block"), lot), "postings")
    gained = gains(postings, buckets).withColumn("block", F.floor(F.col("bucket") / BLOCK).cast("int"))
    by_block = gained.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("g")).select("block", F.col("g.gain").alias("gains"))
    by_block = saved(by_block, "gains")
    met = postings.where(~F.col("target")).join(F.broadcast(by_block), "block")  # buckets rows of numbers, whatever the corpora
    parts = met.select("segment", "postings", "doc_ids", "n_features", "n_words", "gains").mapInArrow(_contributions, "segment long, doc_ids array<long>, n_features array<long>, n_words array<long>, parts array<long>")
    out = saved(parts.groupBy("segment").applyInArrow(_reduced, "doc_id long, n_features long, n_words long, weight long"), "weights")
    discard(postings, by_block)
    return out


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) of a uniform u by the id's SHA-256; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, parts: int) -> DataFrame:
    """rows with `place` from 1 by (score descending, doc_id, n_features): sorted by ranges, whose sizes give each range its start."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranged = saved(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each partition
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    ahead = rows.sparkSession.createDataFrame(starts, "part int, ahead long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.join(F.broadcast(ahead), "part").withColumn("place", F.col("ahead") + nth).drop("part", "ahead")


def scored(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank), one row for each row of docs; rank is null for rows not drawn.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) with the highest scores are drawn, ties to smaller ids,
    nulls last; among rows of one id and score those with fewer features first. Other cases as in weights.
    """
    rows = weights(docs, target, buckets, grams).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    most = percent * n // 100
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = _ranked(rows.where(enough), parts).withColumn("rank", F.when(F.col("place") <= most, F.col("place")))
    names = ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    return placed.select(*names).unionAll(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*names))


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are drawn, columns as before; rows of one id are drawn together if one of them is."""
    (other,) = unused(docs, "drawn")
    ids = saved(scored(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias(other)).distinct(), "drawn")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[other]), "left_semi")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scored(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


SQL = f"""
with tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select cast(range as bigint) as i from range(256)))
), texts as (select doc_id, false as target, text, row_number() over () as k from documents
  union all select null, true, text, row_number() over () from benchmark
), worded as (
  select doc_id, target, k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts
), features as (
  select target, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f from worded
), counted as (select target, k, f, count(*) as n from features group by all
), hashed as (
  select f, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: cast('0x' || h as bigint))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % {BUCKETS} as bucket
  from (select distinct f from counted), tab
), postings as (select target, k, bucket, sum(n) as n from counted join hashed using (f) group by all
), sums as (select bucket, cast(sum(case when target then n else 0 end) as double) as t, cast(sum(case when target then 0 else n end) as double) as s from postings group by bucket
), gains as (select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + {BUCKETS})) / ((s + 1) * (sum(t) over () + {BUCKETS})))) as gain from sums
), weighed as (select k, cast(sum(n * gain) as bigint) as weight from postings join gains using (bucket) where not target group by k
), rows as (
  select doc_id, len(w) as n_words, cast(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as bigint) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from worded left join weighed using (k) where not target
), placed as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as place, count(*) over (partition by n_words >= {LEAST_WORDS}) as n from rows)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and place <= {PERCENT} * n // 100 then place end as rank from placed
"""
