"""Substring deduplication on sliding spans of sentences.

Spans of whole consecutive sentences, and of pieces cut at content-defined places where
sentences don't line up, are hashed; spans that occur again anywhere, in the order of
(doc_id, place), lose their words except in the first occurrence. Only hashes are shuffled
for the counting; places are gathered for repeated spans alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import BLOOM_BITS, bloom, bounded, discard, in_bloom, named, plainly, release, saved, signed, unused
from .textarrays import U64, Words, mix, slices

#: Sentences in a run, and the words a run must have: shorter ones are stock phrases, not passages.
RUN, MIN_WORDS = 3, 12
#: Every WINDOW consecutive words hold the end of a piece, so a passage of 51 words holds whole pieces of 52 - 2 * WINDOW words.
WINDOW, MIN_PIECES = 14, 24
_SENTENCE_SALT = U64(0x9AE16A3B2F90404F)
_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_CLOSERS = ")]}\"'’”“‘»«›‹）」』】》"
_STOPS = ".!?。！？｡…‼⁇⁈⁉।॥؟۔։"
#: By length in bytes, the characters of either kind as big-endian numbers.
_CLOSER_CODES, _STOP_CODES = ({n: [int.from_bytes(c.encode(), "big") for c in chars if len(c.encode()) == n] for n in (1, 2, 3)} for chars in (_CLOSERS, _STOPS))
_LAST = np.zeros(256, bool)
_LAST[[c.encode()[-1] for c in _CLOSERS + _STOPS]] = True


def _tail(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: dict[int, list[int]]) -> np.ndarray:
    """Bytes of the last character of start..end-1 where it is one of codes, else 0."""
    size, code = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
    for n in (1, 2, 3):
        has = end - n >= start
        code |= np.where(has, data[np.maximum(end - n, 0)].astype(np.int64) << (8 * (n - 1)), 0)
        size[has & np.isin(code, codes[n])] = n
    return size


def _stopped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word ends in a full stop, closing quotes and brackets behind it left out."""
    out = np.zeros(len(end), bool)
    at = np.flatnonzero(_LAST[data[end - 1]])
    a, b = start[at], end[at]
    while len(at):
        out[at] = _tail(data, a, b, _STOP_CODES) > 0
        closer = _tail(data, a, b, _CLOSER_CODES)
        go = ~out[at] & (closer > 0) & (b - closer > a)
        at, a, b = at[go], a[go], (b - closer)[go]
    return out


def _units(ends: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, ends, and first unit of each row, of the units that end with the marked words or with their row."""
    rows = row_at[1:]
    ends[rows[rows > 0] - 1] = True
    stops = np.flatnonzero(ends) + 1
    first = np.concatenate(([0], stops[:-1])) if len(stops) else np.zeros(0, np.int64)
    return first, stops, np.searchsorted(first, row_at) if len(ends) else np.zeros(len(row_at), np.int64)


def _least(first: np.ndarray, stop: np.ndarray, row_at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last unit) of the shortest spans of min_words from each unit on, and back from each unit, inside a row.

    They cover every unit of any longer span, and occur wherever it does.
    """
    at = np.arange(len(first))
    row = np.searchsorted(row_at, at, "right") - 1
    to = np.searchsorted(stop, first + min_words)
    back = np.searchsorted(first, stop - min_words, "right") - 1
    on, off = to < row_at[row + 1], back >= row_at[row]
    return np.concatenate((at[on], back[off])), np.concatenate((to[on], at[off]))


class Sentences:
    """Sentences of the rows of one slice: first words, and ends; a row's sentences are consecutive.

    A sentence ends with a word that ends in a full stop of any script, closing quotes and brackets behind it or not,
    before a line break, or with its row.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets, "space")
        n = len(words.start)
        last = np.zeros(n, bool)
        if n:
            last |= _stopped(data, words.start, words.end)
            breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
            last[:-1] |= breaks[words.start[1:]] > breaks[words.end[:-1]]
        self.first, self.stop, self.row_at = _units(last, words.row_at)

    def runs(self, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, ends) of the runs of k sentences inside a row that have min_words words."""
        m = len(self.first) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m)
        row = np.searchsorted(self.row_at, at, "right") - 1
        a, b = self.first[:m], self.stop[k - 1 :]
        pick = (at + k <= self.row_at[row + 1]) & (b - a >= min_words)
        return a[pick], b[pick]

    def pieces(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units as of _units that end with the word of the least hash of any `window` words of a row, the last of equals.

        The ends depend on no word more than a window away, so a repeated passage has them alike but for its margins.
        """
        n, row_at = len(self.words.hash), self.words.row_at
        ends = np.zeros(n, bool)
        if n >= window:
            h = mix(self.words.hash ^ _SENTENCE_SALT)
            at = np.arange(n - window + 1)
            row = np.searchsorted(row_at, at, "right") - 1
            views = np.lib.stride_tricks.sliding_window_view(h, window)[at + window <= row_at[row + 1], ::-1]
            at = at[at + window <= row_at[row + 1]]
            ends[at + window - 1 - views.argmin(1)] = True
        return _units(ends, row_at)

    def spans(self, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, ends) of all spans that are compared, each once: runs of k, least spans of sentences and of pieces."""
        found = [self.runs(k, min_words)]
        for (first, stop, row_at), least in (((self.first, self.stop, self.row_at), min_words), (self.pieces(WINDOW), max(min_words, MIN_PIECES))):
            a, b = _least(first, stop, row_at, least)
            found.append((first[a], stop[b]))
        a, b = (np.concatenate(x) for x in zip(*found))
        both = np.unique(a.astype(np.uint64) << U64(32) | b.astype(np.uint64))
        return (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)

    def hashes(self, a: np.ndarray, b: np.ndarray, second: bool = False) -> np.ndarray:
        """Hashes of the words a..b-1, by either of two bases."""
        base = _STEPS[second]
        h = mix(self.words.hash + _SENTENCE_SALT * U64(1 + second))
        n = len(h)
        steps = np.full(n + 1, U64(base))
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = U64(pow(base, -1, 1 << 64))
        down = np.multiply.accumulate(steps)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _hashes(find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                s = Sentences(data, offsets)
                yield pa.record_batch([signed(s.hashes(*find(s)))], names=["run"])

    return run


def _places(find, wanted, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column(key).to_numpy()
            for a, _, data, offsets in slices(batch.column("text")):
                s = Sentences(data, offsets)
                at, to = find(s)
                h = s.hashes(at, to)
                pick = in_bloom(wanted.value, h)
                at, to, h = at[pick], to[pick], h[pick]
                check = s.hashes(at, to, second=True)
                row = np.searchsorted(s.words.row_at, at, "right") - 1
                base = s.words.row_at[row]
                yield pa.record_batch(
                    [signed(h), signed(check), ids.take(pa.array(row + a)), pa.array(keys[row + a]), pa.array((at - base).astype(np.int32)), pa.array((to - base).astype(np.int32))],
                    names=["run", "check", "doc_id", "row_key", "place", "until"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, places = batch.column("text"), batch.column(batch.num_columns - 1)
        n_sentences, n_removed, n_words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        kept = []
        for a, b, data, offsets in slices(texts):
            s = Sentences(data, offsets)
            n_sentences[a:b] = np.diff(s.row_at)
            raw = data.tobytes()
            for i in range(b - a):
                if not places[a + i].is_valid:
                    kept.append(texts[a + i].as_py())
                    continue
                own = places[a + i].values
                base, end = int(s.words.row_at[i]), int(s.words.row_at[i + 1])
                step = np.zeros(end - base + 1, np.int64)
                np.add.at(step, own.field("place").to_numpy(), 1)
                np.add.at(step, own.field("until").to_numpy(), -1)
                gone = np.cumsum(step[:-1]) > 0
                first = s.first[s.row_at[i] : s.row_at[i + 1]] - base
                n_removed[a + i] = np.logical_or.reduceat(gone, first).sum()
                n_words[a + i] = gone.sum()
                edges = np.concatenate((s.words.start[base:end], offsets[i + 1 : i + 2]))
                turns = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
                head = raw[offsets[i] : edges[0]]
                kept.append((head + b"".join(raw[edges[x] : edges[y]] for x, y in zip(turns[::2], turns[1::2]))).decode())
        names = [c for c in batch.schema.names[:-1] if c != "text"]
        yield pa.record_batch(
            [*(batch.column(c) for c in names), pa.array(kept, pa.string()), pa.array(n_sentences), pa.array(n_removed), pa.array(n_words)],
            names=[*names, "text", "n_sentences", "n_removed", "n_words_removed"],
        )


def _without_repeats(docs: DataFrame, find) -> DataFrame:
    bounded(docs.sparkSession)
    docs = docs.drop("n_sentences", "n_removed", "n_words_removed")
    key, gone_places = unused(docs, "row_key", "places")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    runs = docs.select("text").mapInArrow(_hashes(find), "run long")
    repeated = saved(runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"), "runs")
    release(docs.sparkSession)
    wanted = bloom(repeated, "run", BLOOM_BITS)
    places = keyed.select("doc_id", "text", key).mapInArrow(_places(find, wanted, key), "run long, check long, doc_id long, row_key long, place int, until int")
    places = saved(places.join(repeated, "run"), "places")
    release(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "place")
    wanted.unpersist()
    # From here on a span is known by 128 bits: those that only agree in `run` are first occurrences of their own.
    # Read again for the join, so that it does not take over the grouping's partitions: those of a very frequent span can be split.
    first = saved(places.groupBy("run", "check").agg(F.min(order).alias("first")), "first")
    again = places.join(first, ["run", "check"]).where(order > F.col("first"))
    gone = again.groupBy(F.col("row_key").alias(key)).agg(F.collect_set(F.struct("place", "until")).alias(gone_places))
    gone = saved(gone, "gone")
    discard(places, repeated, first)  # before the texts are shuffled
    release(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    schema = "".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    cut = keyed.join(gone, key, "left").select(*named(docs.columns), gone_places).mapInArrow(_cut, schema + "text string, n_sentences long, n_removed long, n_words_removed long")
    return cut.select(*named(docs.columns), "n_sentences", "n_removed", "n_words_removed")


def dedup(docs: DataFrame, k: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less its repeated sentences, and n_sentences, n_removed (sentences), n_words_removed.

    A run is k consecutive sentences with min_words words or more, compared by their words with A-Z lower-cased; white
    space does not count. Sentences covered by any run that occurred before, by (doc_id, place), nulls last, are removed.
    Runs do not cross documents; a run repeated within its document counts. Null stays null; texts without words and those
    of fewer than k sentences stay. Rows alike in doc_id and text are treated alike: each stands for the same occurrence.
    Columns of docs named as the results are replaced; others stay.
    """
    return plainly(docs, lambda x: _without_repeats(x, lambda s: s.runs(k, min_words)))


def passages(docs: DataFrame, k: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """dedup with spans of any number of sentences and of parts of sentences; n_removed counts sentences that lost words.

    Removed, except where they occur first, are the sentences of dedup's runs; all sentences of any repeated span of
    whole sentences, split alike, of min_words; and all pieces (Sentences.pieces) of any repeated span of whole pieces of
    MIN_PIECES words, which any passage of 51 words holds wherever it starts and ends. So no such passage stays whole;
    at either end, up to WINDOW words of it may stay with a sentence that it shares in part.
    """
    return plainly(docs, lambda x: _without_repeats(x, lambda s: s.spans(k, min_words)))


def digest(documents: DataFrame) -> DataFrame:
    return passages(documents.select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "n_words_removed", "text")
