"""Benchmark decontamination as a prefix-filtered set join of document and item windows.

An item's windows are its runs of ten consecutive words. A window's set is its word
shingles; all of them must occur for the window to occur, so the necessary prefix is
the one rarest shingle, rarity being the number of occurrences in the whole corpus.
Documents look up each of their shingles among the prefixes; where one is found, the
prefix's place in the window and the document's length bound where the window could lie,
and the run there is compared as a whole. Windows are looked up in broadcast blocks of
bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, discard, named, plainly, saved, unused
from .textarrays import U64, Words, mix, slices

WINDOW, SHINGLE = 10, 5
#: Windows of one broadcast block: 32 bytes each.
BLOCK_WINDOWS = 1_000_000
_FILTER_BITS = 1 << 22


def _run_hash(words: Words, n: int) -> np.ndarray:
    return words.shingles(n) ^ mix(np.array([n], np.uint64))


def _item_windows(window: int, shingle: int):
    """(item, n, place, shingle hash, window hash) of every shingle of every window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, "alnum")
                hashes = {n: _run_hash(words, n) for n in range(1, window + 1)}
                for i, count in enumerate(words.count().tolist()):
                    if not count:
                        continue
                    n = min(window, count)
                    k = min(shingle, n)
                    first = words.row_at[i]
                    starts = np.arange(first, first + count - n + 1)
                    places = np.arange(n - k + 1)
                    at = starts[:, None] + places[None, :]
                    m = at.size
                    yield pa.record_batch(
                        [
                            pa.array([batch.column("item_id")[a + i].as_py()] * m, pa.string()),
                            pa.array(np.full(m, n, np.int32)),
                            pa.array(np.tile(places, len(starts)).astype(np.int32)),
                            pa.array(hashes[k][at].ravel().view(np.int64)),
                            pa.array(np.repeat(hashes[n][starts], len(places)).view(np.int64)),
                        ],
                        names=["item", "n", "place", "shingle", "whole"],
                    )

    return run


class _Sieve:
    """Membership of hashes in a sorted array, with a bit filter before the binary search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bits = np.zeros(_FILTER_BITS, bool)
        self.bits[values & U64(_FILTER_BITS - 1)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are members, and where in the values each is first."""
        at = np.flatnonzero(self.bits[hashes & U64(_FILTER_BITS - 1)])
        where = np.searchsorted(self.values, hashes[at])
        same = self.values[np.minimum(where, len(self.values) - 1)] == hashes[at]
        return at[same], where[same]


def _sizes_of(n_values: np.ndarray, shingle: int) -> dict[int, int]:
    return {int(n): min(shingle, int(n)) for n in np.unique(n_values)}


def _frequencies(members, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _Sieve(members.value)
        total = np.zeros(len(sieve.values), np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, "alnum")
                left = words.row_at[1:].repeat(words.count()) - np.arange(len(words.start))
                for k in lengths:
                    h = _run_hash(words, k)
                    at, where = sieve.hits(h)
                    where = where[left[at] >= k]
                    total += np.bincount(where, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(sieve.values[seen].view(np.int64)), pa.array(total[seen])], names=["shingle", "n"])

    return run


#: Columns that scan adds.
NAMES = ("_n", "_hits", "_items")


def _scan(blocks, own: tuple[str, ...]):
    """Adds to each row's state (words, places of hit words, items; named as in own) what the block's windows hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = blocks.value
        sieve = _Sieve(block["prefix"])
        ends = np.searchsorted(block["prefix"], block["prefix"], "right")
        for batch in batches:
            n_words, hits, items = np.zeros(batch.num_rows, np.int64), [], []
            for a, b, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, "alnum")
                n_words[a:b] = words.count()
                row_of = np.repeat(np.arange(b - a), words.count())
                runs = {n: _run_hash(words, n) for n in block["sizes"]}
                found = []  # row, first word, size and window of each occurrence
                for k in sorted(set(block["sizes"].values())):
                    h = runs.get(k)
                    h = _run_hash(words, k) if h is None else h
                    at, where = sieve.hits(h)
                    todo = np.arange(len(at))
                    while len(todo):  # a prefix may stand for several windows
                        w = where[todo]
                        start = at[todo] - block["place"][w]
                        n = block["n"][w]
                        row = row_of[at[todo]]
                        fits = (start >= words.row_at[row]) & (start + n <= words.row_at[row + 1])
                        for size in np.unique(n[fits]).tolist():
                            pick = np.flatnonzero(fits & (n == size))
                            pick = pick[runs[size][start[pick]] == block["whole"][w[pick]]]
                            found.append((row[pick], start[pick], np.full(len(pick), size), block["code"][w[pick]]))
                        where[todo] += 1
                        todo = todo[where[todo] < ends[w]]
                row, start, size, code = (np.concatenate(c) for c in zip(*found)) if found else np.zeros((4, 0), np.int64)
                step = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + size, -1)
                word = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                first = np.searchsorted(word, words.row_at)
                pairs = np.unique(np.stack((row, code), 1)[code >= 0], axis=0)
                cut = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
                for r in range(b - a):
                    hits.append((word[first[r] : first[r + 1]] - words.row_at[r]).tolist())
                    items.append([block["names"][c] for c in pairs[cut[r] : cut[r + 1], 1]])
            if own[1] in batch.schema.names:
                hits = [sorted({*x, *(y or ())}) for x, y in zip(hits, batch.column(own[1]).to_pylist())]
                items = [sorted({*x, *(y or ())}) for x, y in zip(items, batch.column(own[2]).to_pylist())]
            names = [c for c in batch.schema.names if c not in own]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(n_words), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*names, *own],
            )

    return run


def _arrow_rows(df: DataFrame) -> pa.Table:
    return df.toArrow()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with _n (words), _hits (places of words inside any occurrence of a window) and _items (ids of items that occur).

    benchmark: item_id, text. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. An item with fewer words
    than `window`, but not none, is one window; items without words, and null texts, have none. A null item_id takes part
    in hits but is not listed. Repeated items and rows count like one another. An empty benchmark hits nothing. Null text has
    no words. Columns of docs named like the added ones (`names`) are replaced.
    """
    bounded(docs.sparkSession)
    docs = docs.drop(*names)
    parts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_item_windows(window, shingle), "item string, n int, place int, shingle long, whole long")
    parts = saved(parts.distinct(), "item-windows")
    context = docs.sparkSession.sparkContext
    shingles = saved(parts.select("shingle", F.least(F.col("n"), F.lit(shingle)).alias("k")).distinct(), "item-shingles")
    n = shingles.count()
    counted = None
    blocks = max(1, -(-n // block_windows))
    for b in range(blocks):  # one block unless the benchmark is very large
        own = shingles.where(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        rows = _arrow_rows(own)
        values = np.sort(np.unique(rows.column("shingle").to_numpy()).view(np.uint64))
        if not len(values):
            continue
        ks = sorted({int(k) for k in np.unique(rows.column("k").to_numpy())})
        held = context.broadcast(values)
        got = docs.select("text").mapInArrow(_frequencies(held, ks), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("seen"))
        got = saved(got, "shingle-counts")
        held.unpersist()
        counted = got if counted is None else counted.union(got)
    if counted is None:
        return docs.mapInArrow(_scan(context.broadcast(_block(None, shingle)), names), _schema(docs, names))
    ranked = parts.join(counted, "shingle")  # a shingle that the corpus lacks rules its windows out
    needed = parts.groupBy("item", "n", "whole").agg(F.count_distinct("shingle").alias("all"))
    prefixes = ranked.groupBy("item", "n", "whole").agg(F.min(F.struct("seen", "shingle", "place")).alias("p"), F.count_distinct("shingle").alias("there"))
    prefixes = prefixes.join(needed.select(F.col("item").alias("i"), F.col("n").alias("m"), F.col("whole").alias("w"), "all"), F.col("item").eqNullSafe(F.col("i")) & (F.col("n") == F.col("m")) & (F.col("whole") == F.col("w")))
    prefixes = saved(prefixes.where("there = all").select("item", "n", "whole", F.col("p.shingle").alias("prefix"), F.col("p.place").alias("place")), "prefixes")
    discard(parts, shingles, counted)
    out, held, before = docs, None, None
    blocks = max(1, -(-prefixes.count() // block_windows))
    for b in range(blocks):
        if held is not None:  # a further block: what the last one hit is written and its windows are let go, so memory does not grow with the benchmark
            written = saved(out, "hits")
            held.unpersist()
            if before is not None:
                discard(before)
            out = before = written
        held = context.broadcast(_block(_arrow_rows(prefixes.where(F.pmod(F.xxhash64("prefix"), F.lit(blocks)) == b)), shingle))
        out = out.mapInArrow(_scan(held, names), _schema(docs, names))
    discard(prefixes)
    return out


def _schema(docs: DataFrame, names: tuple[str, ...]) -> str:
    own = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in docs.schema)
    return own + ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "array<int>", "array<string>")))


def _block(rows: pa.Table | None, shingle: int) -> dict:
    """Windows in order of their prefix, as arrays: 32 bytes each, and the names of their items."""
    number = lambda c, t=np.int64: np.zeros(0, t) if rows is None else rows.column(c).to_numpy().astype(t, copy=False)
    prefix, whole, n = number("prefix").view(np.uint64), number("whole").view(np.uint64), number("n")
    items = pa.array([], pa.string()) if rows is None else rows.column("item").combine_chunks()
    coded = items.dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((code, whole, n, prefix))
    return {
        "prefix": prefix[order], "whole": whole[order], "place": number("place")[order], "n": n[order], "names": coded.dictionary.to_pylist(), "code": code[order],
        "sizes": _sizes_of(n, shingle),
    }


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(documents.select("doc_id", "text"), benchmark)
    hit = F.size("_hits").cast("long")
    return found.select(
        "doc_id", F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs; columns as before, whatever their names.

    Null and wordless texts stay; repeated rows go or stay together; an empty table or benchmark drops nothing.
    """
    def cleaned(docs: DataFrame) -> DataFrame:
        names = tuple(unused(docs, "n", "hits", "items"))
        return scan(docs, benchmark, names=names).where(F.size(names[1]) == 0).select(*named(docs.columns))

    return plainly(docs, cleaned)


