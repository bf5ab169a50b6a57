"""Language identification by compression with per-language zstandard raw-content dictionaries.

A language's dictionary is made of pieces of a bounded sample of labelled training documents.
Texts and pieces are lower-cased and what is no letter becomes one space. A text is cut into chunks, each chunk is compressed with every dictionary, and the language of
the smallest sum wins. The margin to the next language is the score; narrow ones are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded, discard, named, plainly, saved, unused

#: Training documents sampled for each language, and characters taken from each: the bound of what is fitted.
SAMPLE_DOCS, PIECE_CHARS = 240, 800
#: Languages whose dictionaries a task holds at a time: bounds its memory. More languages are tried block by block.
BLOCK_LANGS = 256
CHUNK_BYTES = 4096
LEVEL = 3
#: Texts whose margin is below this are rejected; measured on training data, see README.
MIN_MARGIN = 0.005
UNKNOWN = "und"
_SLOTS = 1 << 30
_NO_LETTERS = re.compile(r"[\W\d_]+")


class Model(NamedTuple):
    dictionaries: dict[str, bytes]
    counts: dict[str, int]


def _letters(text: str) -> str:
    return _NO_LETTERS.sub(" ", text.lower())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(training: DataFrame, sample_docs: int = SAMPLE_DOCS, piece_chars: int = PIECE_CHARS, block_langs: int | None = None) -> Iterator[Model]:
    """training (doc_id, text, lang) -> dictionary content and count of training documents per language, in blocks of languages, most frequent first.

    About twice `sample_docs` documents of each language, by a hash of the id, reach the driver with one piece each, cut
    at a hashed place; the first `sample_docs` different pieces in hash order make the dictionary. Rows with null text
    or lang are ignored; no rows give no languages. A block is made when it is asked for; the driver holds one at a time.
    """
    rows = training.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(F.lit(17), "doc_id", F.length("text")).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    langs, size = list(counts), block_langs or BLOCK_LANGS
    for first in range(0, len(langs), size):
        yield _dictionaries(rows, {lang: counts[lang] for lang in langs[first : first + size]}, sample_docs, piece_chars)


def _dictionaries(rows: DataFrame, counts: dict[str, int], sample_docs: int, piece_chars: int) -> Model:
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(_SLOTS)) < int(min(1.0, 2 * sample_docs / n) * _SLOTS)))
    at = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - piece_chars)).cast("int") + 1
    pieces: dict[str, dict[str, int]] = {lang: {} for lang in counts}
    for r in rows.where(keep).select("lang", "h", F.substr("text", at, F.lit(piece_chars)).alias("piece")).collect():
        piece = _letters(r.piece)
        pieces[r.lang][piece] = min(r.h, pieces[r.lang].get(piece, r.h))
    content = {lang: "\n".join(sorted(p, key=lambda x: (p[x], x))[:sample_docs]).encode() for lang, p in pieces.items()}
    return Model(content, counts)


#: What is known of a text after some blocks of languages: the best language and the two smallest sizes.
_STATE = ("best", "size", "next")


def _tried(model, chunk_bytes: int, own: tuple[str, ...], left_out: tuple[str, ...]):
    """Adds the state (columns own), or brings it up to date, with the languages of the model; a null best stands for a text without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, counts = model.value
        langs = sorted(dictionaries, key=lambda x: (-counts[x], x))
        coders = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            known = list(zip(*(batch.column(c).to_pylist() for c in own))) if own[0] in batch.schema.names else [(None, None, None)] * batch.num_rows
            out = []
            for text, (best, size, second) in zip(batch.column("text"), known):
                data = _letters(text.as_py() or "").strip()
                if not any(map(str.isalpha, data)):  # signs such as a half or a superscript two are no letters
                    out.append((None, None, None))
                    continue
                data = data.encode()
                chunks = [data[a : a + chunk_bytes] for a in range(0, len(data), chunk_bytes)]
                for lang, coder in zip(langs, coders):  # earlier languages keep a tie
                    n = sum(len(coder(x)) for x in chunks)
                    if size is None or n < size:
                        best, size, second = lang, n, size
                    elif second is None or n < second:
                        second = n
                out.append((best, size, second))
            names = [c for c in batch.schema.names if c not in own + left_out]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([*(batch.column(c) for c in names), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds))], names=[*names, *own])

    return run


def identify(docs: DataFrame, models: Iterable[Model], chunk_bytes: int = CHUNK_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score; only `text` decides. Without keep_text the result has no text.

    models: blocks of languages, most frequent first, as fit gives them. Null text and text without a letter: "und", score 0. Ties go to the language
    with most training documents, then to the first in code point order, score 0.
    With one learned language the score is 1, with none everything is "und". Columns lang_pred and score are replaced. With several blocks the texts are
    read once for each, what is known of them being written in between.
    """
    bounded(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    own = tuple(unused(docs, *_STATE))
    state, held, before, models = docs, None, None, iter(models)
    model, further = next(models, None), next(models, None)
    while model is not None:
        if held is not None:  # a further block: what the last one found is written, its dictionaries are let go
            written = saved(state, "languages")
            held.unpersist()
            if before is not None:
                discard(before)
            state = before = written
        held = docs.sparkSession.sparkContext.broadcast(model)  # BLOCK_LANGS * sample_docs * piece_chars at most
        left_out = () if keep_text or further is not None else ("text",)
        fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in left_out]
        state = state.mapInArrow(_tried(held, chunk_bytes, own, left_out), ", ".join([*fields, *(f"`{c}` {t}" for c, t in zip(own, ("string", "long", "long")))]))
        model, further = further, next(models, None)
    names = named([c for c in docs.columns if keep_text or c != "text"])
    if held is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    best, size, second = map(F.col, own)
    score = F.when(best.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(1 - size / second)
    return state.select(*names, F.coalesce(best, F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def digest(documents: DataFrame) -> DataFrame:
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    found = identify(documents.select("doc_id", "text"), model, keep_text=False)
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < MIN_MARGIN)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", rejected.alias("rejected"))


def accepted(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs whose language is told with a margin; columns as before, also those named lang_pred or score.

    Texts that are null or have no letter go, and so do very short ones whose two best languages tie. Repeated rows are judged
    alike; an empty table stays empty; without labelled rows everything goes.
    """

    def told(docs: DataFrame) -> DataFrame:
        found = identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))
        return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_margin)).select(*named(docs.columns))

    names, clash = docs.columns, [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    other = unused(docs, *clash)
    return plainly(docs.withColumnsRenamed(dict(zip(clash, other))), told).withColumnsRenamed(dict(zip(other, clash))).select(*named(names))
