"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def shingles(text: str | None, k: int = 5) -> set:
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(docs: list[tuple[int, str | None]], percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)"""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_words(texts: list[str | None], n: int = 50) -> list[int]:
    """How many words of each text lie in a run of n words that also starts elsewhere"""
    words = [WORD.findall((t or "").translate(FOLD)) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    return [len({k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}) for w in words]


def repeated_bytes(texts: list[str | None], window: int = 400) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept sha256) of each text"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def decontaminated(text: str | None, items: dict[str, str | None], window: int = 10) -> tuple[int, int, int, str]:
    words = ALNUM.findall((text or "").translate(FOLD))
    hit, found = set(), set()
    for name, t in items.items():
        w = ALNUM.findall((t or "").translate(FOLD))
        n = min(window, len(w))
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in runs:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def split_sentences(text: str | None) -> list[tuple[int, int, tuple]]:
    """(start of its first word, end of its last, words) of every sentence"""
    out, words, start = [], [], 0
    text = text or ""
    found = list(WORD.finditer(text))
    for i, m in enumerate(found):
        if not words:
            start = m.start()
        words.append(m[0].translate(FOLD))
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        if m[0][-1] in ".!?" or "\n" in gap:
            out.append((start, m.end(), tuple(words)))
            words = []
    return out


def sentence_dedup(docs: list[tuple[int, str | None]], k: int, min_words: int) -> dict[int, tuple[int, int, str | None]]:
    """doc_id -> (n_sentences, n_removed, kept text); ids are unique"""
    seen, out = set(), {}
    for i, text in sorted(docs):
        parts = split_sentences(text)
        gone = set()
        for j in range(len(parts) - k + 1):
            run = tuple(w for p in parts[j : j + k] for w in p[2])
            if len(run) >= min_words:
                if run in seen:
                    gone.update(range(j, j + k))
                seen.add(run)
        kept = text
        if gone:
            edges = [p[0] for p in parts] + [len(text)]
            kept = text[: edges[0]] + "".join(text[edges[j] : edges[j + 1]] for j in range(len(parts)) if j not in gone)
        out[i] = (len(parts), len(gone), kept)
    return out


CLOSED = re.compile(r"[.!?。！？｡…‼⁇⁈⁉।॥؟۔։][)\]}\"'’”“‘»«›‹）」』】》]*$")


def whole_sentences(text: str | None) -> list[tuple]:
    """Words of every sentence; it ends in a stop with or without closing quotes and brackets, or with its line"""
    out, words = [], []
    for line in (text or "").split("\n"):
        for w in WORD.findall(line):
            words.append(w.translate(FOLD))
            if CLOSED.search(w):
                out.append(tuple(words))
                words = []
        if words:
            out.append(tuple(words))
            words = []
    return out


def repeated_stretches(docs: list[tuple[int, str | None]], min_words: int) -> dict[int, list[tuple]]:
    """doc_id -> sentences outside of any stretch of whole sentences of min_words that occurred before; ids are unique"""
    seen, out = set(), {}
    for i, text in sorted(docs):
        parts = whole_sentences(text)
        gone = set()
        for j in range(len(parts)):
            for e in range(j + 1, len(parts) + 1):
                run = tuple(w for p in parts[j:e] for w in p)
                if len(run) >= min_words:
                    if run in seen:
                        gone.update(range(j, e))
                    seen.add(run)
        out[i] = [p for j, p in enumerate(parts) if j not in gone]
    return out
