"""Numpy views of Arrow text columns: bytes, words and their 64-bit hashes.

Everything here works on one slice of an Arrow batch inside a Spark task. Slices
are cut by bytes (``slices``), so the memory of a task does not depend on how many
rows Arrow put into a batch; a single text longer than a slice is a slice alone.

Hashes are polynomial prefix hashes modulo 2**64 with a random odd base and a
random 64-bit value per byte: the hash of any byte range costs O(1) after one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = U64(0xC2B2AE3D27D4EB4F | 1)
_VALUES = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(np.uint64) * U64(2) + U64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Word bytes of the two word rules; a byte of 0x80 or more is always inside a word.
WORD_RULES = {"space": _SPACE, "alnum": _ALNUM}

_powers = {"n": 0}


def _inverse(x: int) -> int:
    return pow(int(x), -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the byte base and of its inverse, kept per worker."""
    if _powers["n"] <= n:
        m = max(n + 1, 2 * SLICE_BYTES)
        for key, base in (("up", int(_BASE)), ("down", _inverse(_BASE))):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = m
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def prefix_hash(data: np.ndarray, folded: bool = False) -> np.ndarray:
    """H with H[j] - H[i] = the hash of bytes i..j-1, times base**i."""
    up, _ = powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    v = (_FOLDED if folded else _VALUES)[data]
    v *= up[: len(data)]
    np.cumsum(v, out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start])


class Words:
    """Words of the texts of one slice, A-Z folded: starts and ends in bytes, hashes, first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: str):
        inside = WORD_RULES[rule][data]
        n = len(data)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            at = offsets[:-1]
            at = at[at < n]
            first[at] = inside[at]
            end = offsets[1:][offsets[1:] > 0] - 1
            last[end] = inside[end]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.start, offsets)
        self.hash = range_hash(prefix_hash(data, folded=True), self.start, self.end)

    def count(self) -> np.ndarray:
        return np.diff(self.row_at)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of words i..i+k-1 for each i; those that leave their row are meaningless."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.full(n, U64(k))
        for j in range(k):
            h *= _WORD_BASE
            h += self.hash[j : j + n]
        return mix(h)
