"""Exact removal of repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

Only suffixes that can share a whole window need sorting. Every window holds an anchor: the
leftmost least hash among its short grams. Equal windows have equal anchors at equal places,
so the anchor is the first pass: suffixes are dealt out by anchor, and those whose anchor is
alone are done. Suffixes in a row that share an anchor form a stretch; stretches equal as a
whole settle all their suffixes at once, and one copy stands for all. The others are cut into
blocks of suffixes at equal distances from the anchor: a block whose common bytes occur once is
done, and where all blocks with the same common bytes are equal, they are repeated as a whole.
The suffixes of the blocks left, around the ends of repeated passages, go through passes on
further digits until the depth is reached; equal groups are the repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded, discard, release, saved, signed
from .textarrays import SLICE_BYTES, U64, Words, mix, powers, prefix_hash, range_hash, slices

WINDOW, GRAM, DIGITS, BLOCK = 400, 64, 2, 16
_LOW = U64(0xFFFFFFFF)


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for each i, in linear time."""
    n = len(v) - w + 1
    m = -(-len(v) // w) * w
    blocks = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _bytes_of(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, prefix hashes, offsets) of the bytes of consecutive rows."""
    for a, b, data, offsets in slices(texts, limit):
        yield a, b, prefix_hash(data), offsets


def _words_of(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, prefix hashes, offsets) of the words of consecutive rows."""
    for a, b, data, offsets in slices(texts, limit):
        words = Words(data, offsets, "space")
        n = len(words.hash)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(words.hash * powers(n)[0][:n], out=h[1:])
        yield a, b, h, words.row_at


def stretches(h: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(row, anchor hash, hash of all its bytes, first and last window start within the row, anchor less first) of every stretch."""
    empty = np.zeros(0, np.int64)
    size = len(h) - 1
    n = size - window + 1
    if n <= 0:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    _, down = powers(len(h))
    m = size - gram + 1
    grams = mix((h[gram : gram + m] - h[:m]) * down[:m])
    at = _sliding_least((grams & ~_LOW) | np.arange(m, dtype=np.uint64), window - gram + 1) & _LOW
    at = at.astype(np.int64)
    length = np.diff(offsets)
    row = np.repeat(np.arange(len(length)), length)[:n]
    good = np.arange(n) + window <= offsets[row + 1]
    cut = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]))
    first = np.flatnonzero(cut & good)
    stops = np.flatnonzero(np.concatenate((cut[1:] | ~good[1:], [True])) & good)
    row = row[first]
    return row, grams[at[first]], range_hash(h, first, stops + window), first - offsets[row], stops - offsets[row], at[first] - first


def _anchors(view, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, _, h, offsets in view(batch.column("text")):
                row, anchor, whole, first, last, ahead = stretches(h, offsets, window, gram)
                yield pa.record_batch(
                    [signed(anchor), signed(whole), pa.array(k1[row + a]), pa.array(k2[row + a]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(ahead.astype(np.int32))],
                    names=["anchor", "whole", "k1", "k2", "a", "b", "s"],
                )

    return run


def _lots(view, batch: pa.RecordBatch, lot: int) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """(length, prefix hashes, columns) of the listed rows of each text, `lot` of them at a time."""
    listed = batch.column("todo")
    for r, _, h, _ in view(batch.column("text"), 1):  # text by text
        todo = listed[r].values
        for i in range(0, len(todo), lot):
            part = todo.slice(i, lot)
            yield len(h) - 1, h, {f.name: part.field(f.name).to_numpy() for f in todo.type}


def _repeat(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index n[index] times, and the count within it."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _blocks(view, window: int, size: int):
    """Rows (whole, anchor, j, core, full) of the listed stretches: hashes of the bytes that all and that any suffix of a block has.

    Block j has the suffixes that start j * size to j * size + size - 1 bytes before the anchor; one that leaves its text has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, h, c in _lots(view, batch, 2000):
                at = c["a"] + c["s"]
                low = (at - c["b"]) // size
                i, j = _repeat(c["s"] // size - low + 1)
                j = j + low[i]
                last = at[i] - j * size
                first = last - size + 1
                out = (first < 0) | (last + window > length)
                x, y = np.maximum(first, 0), np.minimum(last, length - window)
                x, y = np.minimum(x, y), np.maximum(x, y)
                hashes = [pa.array(range_hash(h, p, q + window).view(np.int64), mask=out) for p, q in ((y, x), (x, y))]
                yield pa.record_batch([pa.array(c["whole"][i]), pa.array(c["anchor"][i]), pa.array(j.astype(np.int32)), *hashes], names=["whole", "anchor", "j", "core", "full"])

    return run


def _suffixes(view, window: int, size: int, digits: int):
    """Rows (whole, place, d0, d1, ...) of the suffixes of the listed blocks; digits are hashes of equal parts, place is from the anchor."""
    cuts = [window * i // digits for i in range(digits + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, c in _lots(view, batch, 5000):
                last = np.minimum(c["at"] - c["j"] * size, c["b"])  # others belong to another stretch
                first = np.maximum(c["at"] - c["j"] * size - size + 1, c["a"])
                i, place = _repeat(np.maximum(last - first + 1, 0))
                start = first[i] + place
                yield pa.record_batch(
                    [pa.array(c["whole"][i]), pa.array((start - c["at"][i]).astype(np.int32)), *(signed(range_hash(h, start + x, start + y)) for x, y in zip(cuts, cuts[1:]))],
                    names=["whole", "place", *(f"d{i}" for i in range(digits))],
                )

    return run


def _gone(spans, size: int, window: int) -> np.ndarray:
    """Which of `size` places any window that starts at a..b of the spans covers."""
    change = np.zeros(size + 1, np.int64)
    if spans.is_valid:
        np.add.at(change, spans.values.field("a").to_numpy(), 1)
        np.add.at(change, spans.values.field("b").to_numpy() + window, -1)
    return np.cumsum(change[:-1]) > 0


def _removal(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            size, removed, runs = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            kept = []
            for a, b, data, offsets in slices(batch.column("text")):
                for i in range(b - a):
                    own = data[offsets[i] : offsets[i + 1]]
                    size[a + i] = len(own)
                    if spans[a + i].is_valid:
                        gone = _gone(spans[a + i], len(own), window)
                        removed[a + i] = gone.sum()
                        runs[a + i] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                        own = own[~gone]
                    kept.append(own.tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary()), batch.column("n_words_removed")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_words_removed"])

    return run


def _words_covered(words: int):
    """Adds to each row's key how many words the spans of windows of `words` words cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for spans in batch.column("spans"):
                a, b = (spans.values.field(c).to_numpy() for c in "ab")
                step = np.zeros(int(b.max()) + words + 1, np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, b + words, -1)
                n.append(int((np.cumsum(step) > 0).sum()))
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64())], ["k1", "k2", "n_words_removed"])

    return run


def named_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, text): the texts that aren't null, each named by two hashes."""
    return docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), "text").where("text is not null")


def repeated_spans(named: DataFrame, window: int = WINDOW, gram: int = GRAM, digits: int = DIGITS, size: int = BLOCK, by_words: bool = False) -> DataFrame:
    """(k1, k2, spans array of (a, b)): for each text of named_texts the starts a..b of its repeated windows, if any.

    Windows and places count bytes, or words; stretches of words are short, so their suffixes go to the digit passes without blocks.
    """
    view = _words_of if by_words else _bytes_of
    spark = named.sparkSession
    bounded(spark)
    copies = named.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.octet_length("text")).alias("bytes"))
    anchors = named.where(F.octet_length("text") >= window).mapInArrow(_anchors(view, window, gram), "anchor long, whole long, k1 long, k2 long, a int, b int, s int")
    anchors = saved(anchors, "anchors")
    copied = copies.where(f"n > 1 and bytes >= {window}")
    if by_words:
        copied = anchors.join(copied, ["k1", "k2"], "left_semi").select("k1", "k2", "a", "b").distinct()
    else:
        copied = copied.select("k1", "k2", F.lit(0).alias("a"), (F.col("bytes") - window).alias("b"))
    # By anchor, then by stretch: a stretch occurs again if it does so at another place, or in another text.
    several = anchors.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    several = saved(several, "frequent-anchors")  # read again, so that both sides of the join are plain shuffles, which can be split
    place = F.xxhash64("k1", "k2", "a")
    # Grouped by a struct, which the join's partitioning does not serve: so the join of a very frequent anchor can be split.
    groups = anchors.join(several, "anchor").groupBy(F.struct("anchor", "whole").alias("key"))
    kinds = groups.agg((F.min(place) != F.max(place)).alias("again"), *(F.first(c).alias(c) for c in ("mixed", "k1", "k2", "a", "b", "s")))
    kinds = saved(kinds.where("again or mixed").select("key.anchor", "key.whole", "again", "mixed", "k1", "k2", "a", "b", "s"), "stretches")
    release(spark)

    def of_texts(rows: DataFrame, columns: list[str]) -> DataFrame:
        todo = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct(*columns)).alias("todo"))
        return named.join(todo, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "todo")

    at = (F.col("a") + F.col("s")).alias("at")
    blocks = None
    if by_words:
        size = 1 << 30
        placed = kinds.where("mixed").select("whole", "k1", "k2", "a", "b", at, F.lit(0).alias("j"))
    else:
        blocks = of_texts(kinds.where("mixed"), ["whole", "anchor", "a", "b", "s"]).mapInArrow(_blocks(view, window, size), "whole long, anchor long, j int, core long, full long")
        blocks = saved(blocks, "blocks")
        release(spark)
        cores = blocks.groupBy("j", "core").agg(F.min("full").alias("p"), F.max("full").alias("q")).where("p <> q").select("j", "core")
        edges = blocks.where("core is null").select("anchor", "j").distinct()
        open_blocks = blocks.join(cores, ["j", "core"], "left_semi").select("whole", "j", "full").union(blocks.join(edges, ["anchor", "j"], "left_semi").select("whole", "j", "full"))
        one_each = open_blocks.where("full is not null").dropDuplicates(["j", "full"]).union(open_blocks.where("full is null").distinct())
        placed = one_each.join(kinds.select("whole", "k1", "k2", "a", "b", (F.col("a") + F.col("s")).alias("at")), "whole")
    columns = ", ".join(f"d{i} long" for i in range(digits))
    left = saved(of_texts(placed, ["whole", "j", "at", "a", "b"]).mapInArrow(_suffixes(view, window, size, digits), f"whole long, place int, {columns}"), "suffixes")
    release(spark)
    # By one digit more in each pass: a suffix stays while another stretch has one with the same digits so far.
    for depth in range(1, digits + 1):
        keys = [f"d{i}" for i in range(depth)]
        groups = left.groupBy(*keys).agg(F.min("whole").alias("p"), F.max("whole").alias("q")).where("p <> q").select(*keys)
        before, left = left, saved(left.join(groups, keys, "left_semi"), "suffixes")
        discard(before)
    found = left.select("whole", F.col("place").alias("x"), F.col("place").alias("y"))
    if blocks is not None:
        same = blocks.where("full is not null").groupBy("j", "full").agg(F.min("whole").alias("p"), F.max("whole").alias("q")).where("p <> q").select("j", "full")
        settled = blocks.join(same, ["j", "full"], "left_semi").select("whole", (-F.col("j") * size - (size - 1)).alias("x"), (-F.col("j") * size).alias("y"))
        found = settled.union(found)
    single = found.join(kinds.where("not again").select("whole", "k1", "k2", (F.col("a") + F.col("s")).alias("at")), "whole")
    single = single.select("k1", "k2", (F.col("at") + F.col("x")).alias("a"), (F.col("at") + F.col("y")).alias("b"))
    full = anchors.join(kinds.where("again").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select("k1", "k2", "a", "b").distinct()
    spans = saved(full.union(single).union(copied).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    discard(anchors, several, kinds, left, *([] if blocks is None else [blocks]))
    release(spark)
    return spans


#: Words in a row that are removed as a passage, where repeats are counted by words.
WORDS = 50


def remove(docs: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_words_removed) per row of docs (doc_id, text; other columns are ignored).

    A byte goes if a string of `window` bytes over it also starts anywhere else in the rows' texts, repeated rows
    included; overlaps count; `kept` are the other bytes. n_words_removed counts the words that lie in a run of `words` words, A-Z
    lower-cased and white space ignored, that also starts anywhere else. Null or short text: nothing goes. Every row
    gives one row; an empty table none. Memory of a task grows with its longest text, by about 100 bytes for each of its bytes.
    Digits are 64-bit hashes: windows count as equal if their anchors' and their stretches' or parts' hashes agree.
    """
    named = named_texts(docs)
    by_words = repeated_spans(named, words, max(1, words // 12), by_words=True)
    covered = saved(by_words.mapInArrow(_words_covered(words), "k1 long, k2 long, n_words_removed long"), "words")
    discard(by_words)
    found = repeated_spans(named, window).join(covered, ["k1", "k2"], "full")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"))
    joined = rows.join(found, ["k1", "k2"], "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans", F.coalesce("n_words_removed", F.lit(0)).alias("n_words_removed"))
    return joined.mapInArrow(_removal(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_words_removed long")


def digest(documents: DataFrame) -> DataFrame:
    """remove's rows with the kept bytes as their SHA-256."""
    return remove(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_words_removed")
