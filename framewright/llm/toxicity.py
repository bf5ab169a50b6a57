"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear support vector machine.

A text is taken as pieces: words without what stands between their letters, and runs of letters spelled out one by one. The kernel of two
pieces counts the subsequences of three letters that both have within five places, each place that a subsequence spans costing a
factor; signs within a word, and letters inserted into it, so lower the kernel and do not end it. Landmarks are pieces of labelled
sentences; the kernel with them, whitened, is a piece's vector (Nystroem). The machine learns from documents' labels by the
sentences that speak for them: of a toxic document the piece that scores highest stands for it, of others all may not
reach the margin. A linear function of kernels with landmarks is one of subsequences, so a text is scored with a table of weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .storage import bounded, unused
from .textarrays import WORD_RULES, prefix_hash, range_hash, slices

#: Labelled documents sampled for each label, and bytes of whole sentences taken from each: the bound of what is fitted.
SAMPLE_DOCS, SAMPLE_BYTES = {1: 1000, 0: 2000}, 4096
#: Landmarks; letters of the longest piece, longer words are cut into overlapping ones.
LANDMARKS, LONGEST = 256, 24
#: Places that a subsequence of three letters may span, and the factor for each place beyond three.
SPAN, DECAY = 5, 0.6
ROUNDS, COST = 4, 1.0
_SLOTS = 1 << 30
#: Standard errors by which a piece is told as one of toxic texts by itself.
CLEAR = 4.0
_ENDS = re.compile(r"(?<=[.!?\n])\s+")
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_GAP = 1

_LETTER = WORD_RULES["alnum"]
_WORD = WORD_RULES["space"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Codes of six bits: 0 for signs, 1 and 2 for a piece's start and end, then a to z, digits, and other bytes.
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(3, 29)
_CODE[48:58] = np.arange(29, 39)
_CODE[128:] = 39 + np.arange(128) % 25
FEATURES = 1 << 18


class Pieces(NamedTuple):
    """Pieces of a slice of texts: the letters with signs as gaps, each piece's start and end there, its text, and its first and last byte in the slice."""

    letters: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> Pieces:
    low = _LOWER[data]
    if len(data) > 1:  # capital letters of Latin-1 in UTF-8
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][capital] += 32
    at = np.flatnonzero(_LETTER[low])
    if not len(at):
        none = np.zeros(0, np.int64)
        return Pieces(np.zeros(0, np.uint8), none, none, none, none, none)
    row = np.searchsorted(offsets, at, "right") - 1
    spaces = np.cumsum(~_WORD[data])[at]
    break_ = np.concatenate(([True], (row[1:] != row[:-1]) | (spaces[1:] != spaces[:-1])))
    other_row = np.concatenate(([True], row[1:] != row[:-1]))
    alone = break_ & np.concatenate((break_[1:], [True]))  # letters that are words
    heads = np.flatnonzero(alone & (np.concatenate(([True], ~alone[:-1])) | other_row))
    tails = np.flatnonzero(alone & np.concatenate((~alone[1:] | other_row[1:], [True]))) + 1
    spelled = tails - heads >= 3  # letters of one text, spelled out: one piece
    for a, b in zip(heads[spelled].tolist(), tails[spelled].tolist()):
        break_[a + 1 : b] = False
    gap = ~break_
    gap[1:] &= at[1:] != at[:-1] + 1
    place = np.arange(len(at)) + np.cumsum(gap)
    letters = np.full(len(at) + int(gap.sum()), _GAP, np.uint8)
    letters[place] = low[at]
    head = np.flatnonzero(break_)
    tail = np.concatenate((head[1:], [len(at)])) - 1
    start, end = place[head], place[tail] + 1
    long_ = end - start > LONGEST
    parts = np.where(long_, -(-(end - start) // (LONGEST // 2)) - 1, 1)
    own = np.repeat(np.arange(len(head)), parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = start[own] + nth * (LONGEST // 2)
    return Pieces(letters, cut, np.where(long_[own], np.minimum(cut + LONGEST, end[own]), end[own]), row[head][own], at[head][own], at[tail][own] + 1)


def subsequences(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(piece, feature, weight) of all subsequences of the pieces, an array for each way to step over places."""
    size = end - start + 2
    total = int(size.sum())
    piece = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    inner = np.arange(total) - first[piece]
    code = np.zeros(total, np.int32)
    middle = (inner > 0) & (inner < size[piece] - 1)
    code[middle] = _CODE[letters[(start[piece] + inner - 1)[middle]]]
    code[first], code[first + size - 1] = 1, 2
    for a, b in _STEPS:
        if total <= b:
            continue
        x, y, z = code[:-b], code[a : a - b], code[b:]
        good = np.flatnonzero((piece[:-b] == piece[b:]) & (x > 0) & (y > 0) & (z > 0))
        yield piece[good], (x[good] << 12) | (y[good] << 6) | z[good], DECAY ** (b - 2)


def decisions(letters: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the weights of each piece's subsequences, by the length of their vector."""
    value, square = np.zeros(len(start)), np.zeros(len(start))
    for piece, feature, weight in subsequences(letters, start, end):
        value += np.bincount(piece, table[feature], len(start)) * weight
        square += np.bincount(piece, minlength=len(start)) * weight**2
    return value / np.sqrt(np.maximum(square, 1e-12))


def distinct(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct pieces, and for each piece its place among them."""
    hashes = range_hash(prefix_hash(p.letters), p.start, p.end)
    _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    return at, back


def piece_scores(p: Pieces, table: np.ndarray) -> np.ndarray:
    at, back = distinct(p)
    return decisions(p.letters, p.start[at], p.end[at], table)[back]


class Model(NamedTuple):
    """Weights of subsequences; score = 1 / (1 + exp(-(slope * d + shift))) of a text's highest decision d."""

    table: np.ndarray
    slope: float
    shift: float
    landmarks: tuple[bytes, ...]

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -50, 50)))


def _sampled(limit: int):
    """Whole sentences of each text, at most `limit` bytes, those with the least hashes; a longer sentence is cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if len(text.encode()) > limit:
                    sentences = [s[i : i + limit // 8] for s in _ENDS.split(text) for i in range(0, len(s), limit // 8)]
                    order, size, kept = sorted(range(len(sentences)), key=lambda i: xxhash.xxh64_intdigest(sentences[i])), 0, []
                    for i in order:
                        size += len(sentences[i].encode()) + 1
                        if size > limit:
                            break
                        kept.append(i)
                    text = "\n".join(sentences[i] for i in sorted(kept))
                out.append(text)
            yield pa.record_batch([batch.column("toxic"), batch.column("h"), pa.array(out, pa.string())], names=["toxic", "h", "text"])

    return run


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss; the last coefficient is the threshold."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        grad = ridge @ w - x[on].T @ (cost[on] * y[on] * margin[on])
        step = np.linalg.solve(ridge + (x[on] * cost[on, None]).T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _platt(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through labelled decisions, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack((d, np.ones(len(d))), 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - t) + 1e-3 * w
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class _Sample:
    """Pieces of the sampled texts, in slices, with a row for each text."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        self.labels, self.slices = labels, []
        for a, _, data, offsets in slices(pa.array(texts, pa.large_string())):
            p = pieces_of(data, offsets)
            at, back = distinct(p) if len(p.start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            pairs = np.unique((p.row + a) * (len(at) + 1) + back) if len(at) else np.zeros(0, np.int64)
            self.slices.append((p, at, pairs // (len(at) + 1), pairs % (len(at) + 1)))  # distinct (text, piece)

    def lexicon(self, least: float) -> dict[bytes, int]:
        """Pieces that toxic texts have more often, by `least` standard errors and at least five times as often as others, with their numbers of toxic texts, clearest first."""
        hashes = np.concatenate([range_hash(prefix_hash(p.letters), p.start[at], p.end[at])[piece] for p, at, _, piece in self.slices])
        toxic = np.concatenate([self.labels[row] > 0 for _, _, row, _ in self.slices])
        values, back = np.unique(hashes, return_inverse=True)
        seen = np.stack([np.bincount(back[toxic == k], minlength=len(values)) for k in (False, True)])
        n = np.array([(self.labels <= 0).sum(), (self.labels > 0).sum()])
        mean = (seen.sum(0) + 1) / (n.sum() + 2)
        z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(mean * (1 - mean) * (1 / n).sum())
        clear = {int(values[i]): (-float(z[i]), int(seen[1, i])) for i in np.flatnonzero((z >= least) & (seen[1] >= 3) & (seen[1] * n[0] >= 5 * seen[0] * n[1]))}
        found: dict[bytes, tuple[float, int]] = {}
        for p, at, _, _ in self.slices:
            own = range_hash(prefix_hash(p.letters), p.start[at], p.end[at])
            for i in np.flatnonzero(np.isin(own, np.array(list(clear), np.uint64))):
                found[p.letters[p.start[at[i]] : p.end[at[i]]].tobytes()] = clear[int(own[i])]
        return {w: found[w][1] for w in sorted(found, key=lambda w: (found[w], w))}

    def contrast(self) -> np.ndarray:
        """For each feature how much more of the toxic texts have it, in standard errors."""
        n1, n0 = max(1, (self.labels > 0).sum()), max(1, (self.labels <= 0).sum())
        seen = np.zeros((2, FEATURES))
        for p, at, row, piece in self.slices:
            order = np.argsort(piece, kind="stable")
            cut = np.searchsorted(piece[order], np.arange(len(at) + 1))
            for own, feature, _ in subsequences(p.letters, p.start[at], p.end[at]):
                sizes = (cut[1:] - cut[:-1])[own]
                places = np.repeat(cut[:-1][own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                pairs = np.unique(row[order[places]].astype(np.int64) * FEATURES + np.repeat(feature, sizes))
                toxic = self.labels[pairs // FEATURES] > 0
                for k in (0, 1):
                    seen[k] += np.bincount(pairs[toxic == k] % FEATURES, minlength=FEATURES)
        p1, p0 = seen[1] / n1 / len(_STEPS), seen[0] / n0 / len(_STEPS)
        mean = (seen[0] + seen[1] + 1) / (n0 + n1 + 2) / len(_STEPS)
        return (p1 - p0) / np.sqrt(mean * (1 - mean).clip(1e-3) * (1 / n1 + 1 / n0))

    def best(self, table: np.ndarray, k: int) -> list[list[tuple[float, bytes]]]:
        """The k highest decisions of each text, with their pieces."""
        out: list[list[tuple[float, bytes]]] = [[] for _ in self.labels]
        for p, at, row, piece in self.slices:
            if not len(at):
                continue
            d = decisions(p.letters, p.start[at], p.end[at], table)[piece]
            order = np.lexsort((piece, -d, row))
            nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            for i in order[nth < k]:
                q = at[piece[i]]
                out[row[i]].append((float(d[i]), p.letters[p.start[q] : p.end[q]].tobytes()))
        return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), end - size, end


class _Landmarks:
    """Nystroem's map: the kernel with the landmarks, whitened."""

    def __init__(self, words: list[bytes]):
        self.words, self.column = words, np.full(FEATURES, -1, np.int64)
        parts = list(subsequences(*_joined(words)))
        used = np.unique(np.concatenate([f for _, f, _ in parts]))
        self.column[used] = np.arange(len(used))
        self.used = used
        self.matrix = self._vectors(words)
        values, axes = np.linalg.eigh(self.matrix @ self.matrix.T)
        good = values > 1e-6 * values.max()
        self.turn = axes[:, good] / np.sqrt(values[good])

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        out, square = np.zeros((len(words), len(self.used))), np.zeros(len(words))
        for piece, feature, weight in subsequences(*_joined(words)):
            square += np.bincount(piece, minlength=len(words)) * weight**2
            at = self.column[feature]
            np.add.at(out, (piece[at >= 0], at[at >= 0]), weight)
        return out / np.sqrt(np.maximum(square, 1e-12))[:, None]

    def map(self, words: list[bytes]) -> np.ndarray:
        return np.concatenate([self._vectors(words[i : i + 512]) @ self.matrix.T for i in range(0, len(words), 512)]) @ self.turn

    def table(self, w: np.ndarray) -> np.ndarray:
        """The linear function w of the map as weights of subsequences."""
        out = np.zeros(FEATURES)
        out[self.used] = self.matrix.T @ (self.turn @ w)
        return out


def _disguised(word: bytes, rng: np.random.RandomState) -> list[bytes]:
    """The piece with a sign or a letter inserted at some place, and with signs between all letters."""
    i = rng.randint(1, max(2, len(word)))
    bare = word.replace(bytes([_GAP]), b"")
    letter = bytes([97 + rng.randint(26)])
    return [w[: 2 * LONGEST] for w in (word[:i] + bytes([_GAP]) + word[i:], word[:i] + letter + word[i:], bytes([_GAP]).join(bytes([c]) for c in bare))]


def _landmarks(strong: list[bytes], hard: list[bytes], others: list[bytes], n: int, rng: np.random.RandomState) -> list[bytes]:
    """Half of the landmarks stand for toxic texts, a quarter for what comes next to them elsewhere, the others are drawn at random.

    One that resembles an earlier one closely adds nothing and is passed over while there are others.
    """
    chosen: list[bytes] = []
    for words, most in ((strong, n // 2), (hard, 3 * n // 4)):
        words = [w for w in words[: 4 * n] if w not in chosen]
        if not words:
            continue
        space = _Landmarks(words)
        near = space.matrix @ space.matrix.T
        taken: list[int] = []
        for i in range(len(words)):
            if len(chosen) + len(taken) < most and (not taken or near[i, taken].max() < 0.9):
                taken.append(i)
        chosen += [words[i] for i in taken]
    rest = sorted(set(others) - set(chosen))
    return chosen + [rest[i] for i in rng.permutation(len(rest))[: n - len(chosen)]]


def _heads(top: list, rows: np.ndarray, k: int) -> dict[bytes, int]:
    """How many of the texts have each piece among their k highest."""
    out: dict[bytes, int] = {}
    for i in rows:
        for _, word in top[i][:k]:
            out[word] = out.get(word, 0) + 1
    return out


def _without_repeats(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The texts without sentences that an earlier one has: copies would count as evidence of their own."""
    seen: set[str] = set()
    out, keep = [], []
    for i, text in enumerate(texts):
        own = [s for s in dict.fromkeys(_ENDS.split(text)) if s not in seen]
        seen.update(own)
        if any(own):
            out.append(" ".join(own))
            keep.append(i)
    return out, labels[keep]


def _examples(own: dict[bytes, int], against: dict[bytes, int], rng: np.random.RandomState) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces with labels and costs, each class with the same sum: those of toxic texts, also disguised, and those of the others."""
    words, y, cost = [], [], []
    for of, label in ((own, 1.0), (against, -1.0)):
        parts = [(v, n * share) for w, n in sorted(of.items()) for v, share in ((w, 1.0), *((v, 0.2) for v in _disguised(w, rng)))]
        whole = sum(c for _, c in parts) / 500
        words += [v for v, _ in parts]
        y += [label] * len(parts)
        cost += [c / whole for _, c in parts]
    return words, np.array(y), np.array(cost)


def train(texts: list[str], labels: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 11) -> Model | None:
    """The model of labelled texts (1: toxic, -1: not); None if a label or every letter is missing."""
    texts, labels = _without_repeats(texts, labels)
    if not (labels > 0).any() or not (labels <= 0).any():
        return None
    sample, rng = _Sample(texts, labels), np.random.RandomState(seed)
    toxic, clean = np.flatnonzero(labels > 0), np.flatnonzero(labels <= 0)
    top = sample.best(sample.contrast(), 3)
    if not any(top[i] for i in toxic) or not any(top[i] for i in clean):
        return None
    known = sample.lexicon(CLEAR)
    own, table = dict(known) or _heads(top, toxic, 1), None
    against: dict[bytes, int] = {}
    for _ in range(rounds):
        hard = _heads(top, clean, 3)
        for word, n in hard.items():
            against[word] = against.get(word, 0) + n
        space = _Landmarks(_landmarks(list(own), sorted(hard, key=lambda w: (-hard[w], w)), list(against), landmarks, rng))
        words, y, cost = _examples(own, against, rng)
        w, _ = _newton(space.map(words), y, COST * cost)
        table = space.table(w)
        top = sample.best(table, 3)
        limit = np.quantile([top[i][0][0] for i in clean if top[i]], 0.98)  # a toxic text of which nothing stands out says nothing
        spoken = _heads([[x for x in t if x[0] > limit] for t in top], toxic, 1)
        own = known | {word: max(n, known.get(word, 0)) for word, n in spoken.items()}
        own = {word: own[word] for word in sorted(own, key=lambda x: (-own[x], x))} or _heads(top, toxic, 1)
    highest = np.array([t[0][0] if t else -1e9 for t in sample.best(table, 1)])
    there = highest > -1e9
    slope, shift = _platt(highest[there], labels[there])
    return Model(table.astype(np.float32), max(slope, 1e-6), shift, tuple(space.words))


def _place(doc_id: Column) -> Column:
    return F.xxhash64(F.lit(23), doc_id)


def _share(rows: DataFrame, sample_docs: dict[int, int]) -> DataFrame:
    """About 1.2 times so many rows of either label, those with the least h."""
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (F.pmod("h", F.lit(_SLOTS)) < int(min(1.0, 1.2 * sample_docs[label] / n) * _SLOTS)))
    return rows.where(keep)


def fit(training: DataFrame, sample_docs: dict[int, int] = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """training (doc_id, text, toxic) -> model, or None where there are no toxic or no other texts with letters.

    By a hash of the id about `sample_docs` documents of either label reach the driver, each with at most `sample_bytes` bytes of its
    sentences. Rows with null text or label are ignored.
    """
    bounded(training.sparkSession)
    rows = training.where("text is not null and toxic is not null").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text", _place(F.col("doc_id")).alias("h"))
    got = _share(rows, sample_docs).mapInArrow(_sampled(sample_bytes), "toxic int, h long, text string").collect()
    texts, labels = [], []
    for label in (1, 0):
        own = sorted((r.h, r.text) for r in got if r.toxic == label)[: sample_docs[label]]
        texts += [t for _, t in own]
        labels += [2 * label - 1] * len(own)
    return train(texts, np.array(labels)) if set(labels) == {-1, 1} else None


def _score(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            n = batch.num_rows
            decision, first, last = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            found: list = [None] * n
            for a, b, data, offsets in slices(batch.column("text")):
                p = pieces_of(data, offsets)
                if m is None or not len(p.start):
                    continue
                d = piece_scores(p, m.table)
                order = np.lexsort((-d, p.row))
                rows, at = np.unique(p.row[order], return_index=True)
                pick = order[at]
                decision[a + rows] = d[pick]
                for r, q in zip((a + rows).tolist(), pick.tolist()):
                    if m.score(d[q]) >= 0.5:
                        found[r] = data[p.first[q] : p.last[q]].tobytes().decode(errors="replace")
            score = np.zeros(n) if m is None else np.where(np.isfinite(decision), m.score(np.where(np.isfinite(decision), decision, -1e6)), 0.0)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(score), pa.array(found, pa.string())], names=[*keep, "score", "evidence"])

    return run


def toxicity(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """docs with score (0 to 1) and evidence, the words that decide where the score is 0.5 or more; only `text` decides.

    Null texts and those without a letter or digit score 0, and so does everything without a model. Repeated rows score alike. Columns
    score and evidence are replaced. Without keep_text the result has no text.
    """
    bounded(docs.sparkSession)
    docs = docs.drop("score", "evidence")
    spread = docs.sparkSession.sparkContext.broadcast(model)  # a table of 2**18 floats and the landmarks
    kept = docs if keep_text else docs.drop("text")
    schema = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in kept.schema) + "score double, evidence string"
    return docs.mapInArrow(_score(spread, kept.columns), schema)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; labels (doc_id, toxic): of repeated ids the highest label counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    learned = _share(known.where(~held_out(F.col("doc_id"))).withColumn("h", _place(F.col("doc_id"))), SAMPLE_DOCS).select("doc_id", "toxic")
    model = fit(documents.select("doc_id", "text").join(F.broadcast(learned), "doc_id"))  # a few thousand labels, whatever the tables
    found = toxicity(documents.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def kept(docs: DataFrame, model: Model | None, most: Column | float = 0.5) -> DataFrame:
    """The rows of docs that score below `most`; columns as before, also those named score or evidence."""
    clash = [c for c in docs.columns if c.lower() in ("score", "evidence")]
    other = unused(docs, *clash)
    renamed = docs.withColumnsRenamed(dict(zip(clash, other)))
    found = toxicity(renamed, model).where(F.col("score") < most).drop("score", "evidence")
    return found.withColumnsRenamed(dict(zip(other, clash)))
