"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

An item of n words contaminates a document if some run of the document's words is within k = floor(RATE * n)
word edits of it. Words are runs of letters and digits in lower case.

1. Windows of the item's size are taken at each place where they can match: of k + 1 disjoint pieces of the
   item, k edits leave one intact, so only windows that hold an intact piece, shifted by k at most, are
   candidates. This loses no match.
2. The Chakraborty-Goldenberg-Koucky embedding walks through window and item with the same random bits and
   writes 3n symbols; few edits let both walks write mostly the same, so edit distance becomes Hamming distance.
3. Bit sampling: ``TABLES`` hashes of ``SYMBOLS`` sampled places of each of ``WALKS`` embeddings; a window
   that agrees with the item in any of them is a candidate. More walks and tables raise recall; the ones here
   find over 0.99 of windows at the limit (measured in the tests).
4. Exact edit distance of the item to the text from the window's start, with a free end.

The benchmark is the stated query set: it is held in blocks of ``ITEM_WORDS`` words at most, so what is
broadcast has a fixed bound, and a larger benchmark takes more passes over the documents.

Defined results: items of fewer than ``LEAST`` words (and null ones) contaminate nothing; null and empty
documents are clean; repeated items and documents are answered each for itself; several places of an item in
a document give one row, the closest, then the first; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.llm._common import small_batches
from quantara.llm._text import U64, Block, blocks, mix, ragged, span_hashes, spans

RATE = 0.2
LEAST = 5
WALKS, TABLES, SYMBOLS = 6, 24, 2
ITEM_WORDS = 50_000
SEED = 20_160_501
#: Windows embedded at a time, and symbols that these may have (one window at least).
CHUNK, CHUNK_SYMBOLS = 1024, 1 << 21

WORDY = np.zeros(256, bool)
WORDY[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ODD = U64(0xD6E8FEB86659FD93)


def _hashed_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (never 0) and the first word of each text, with the end."""
    starts, ends = spans(block, WORDY)
    return span_hashes(block.data, starts, ends) | U64(1), np.searchsorted(starts, block.bounds)


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def _gram(words: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - q + 1), U64)
    for j in range(q):
        out = mix(out * _ODD + words[j : j + len(out)])
    return out


def embed(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings of words[start : start + length]: steps x WALKS x windows symbols, 0 behind the end."""
    walks = mix(np.arange(WALKS, dtype=U64) + U64(SEED))
    at = np.zeros((WALKS, len(starts)), np.int64)
    out = np.zeros((steps, WALKS, len(starts)), U64)
    for j in range(steps):
        inside = at < lengths
        symbol = np.where(inside, words[np.where(inside, starts + at, 0)], U64(0))
        out[j] = symbol
        coin = mix(symbol ^ mix(walks + U64(j * int(_ODD) % (1 << 64)))[:, None]) >> U64(63)
        at += inside & (coin == U64(1))
    return out


@dataclass
class Index:
    """The items of a block of the benchmark: words, pieces by length, sampled places and their hashes."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    edits: np.ndarray
    seeds: dict = field(default_factory=dict)  # piece length: (bit map, hashes, bounds, item, offset)
    places: np.ndarray | None = None  # items x WALKS x TABLES x SYMBOLS
    tables: np.ndarray | None = None  # items x WALKS x TABLES

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def build(ids: list, texts: list, rate: float = RATE) -> Index:
    """An index of the items that have ``LEAST`` words."""
    parts, kept = [], []
    for block in blocks(_lowered(pa.array(texts, pa.large_string()))):
        words, first = _hashed_words(block)
        for i in range(block.n):
            if first[i + 1] - first[i] >= LEAST:
                parts.append(words[first[i] : first[i + 1]])
                kept.append(block.first + i)
    lengths = np.array([len(x) for x in parts], np.int64)
    index = Index(np.array([ids[i] for i in kept], np.int64), np.concatenate([*parts, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), np.floor(lengths * rate + 1e-9).astype(np.int64))
    pieces: dict[int, list] = {}
    for item, (words, k) in enumerate(zip(parts, index.edits.tolist(), strict=True)):
        q = len(words) // (k + 1)
        for offset in range(0, q * (k + 1), q):
            pieces.setdefault(q, []).append((int(_gram(words[offset : offset + q], q)[0]), item, offset))
    for q, found in pieces.items():
        hashes = np.array([x[0] for x in found], U64)
        by = np.argsort(hashes, kind="stable")
        unique, begin = np.unique(hashes[by], return_index=True)
        item, offset = (np.array([x[c] for x in found], np.int64)[by] for c in (1, 2))
        bits = np.zeros(1 << 20, bool)
        bits[(unique & U64(0xFFFFF)).astype(np.int64)] = True
        index.seeds[q] = (bits, unique, np.append(begin, len(found)), item, offset)
    n = len(parts)
    rng = np.random.default_rng(SEED)
    # Later steps mostly lie behind the walk's end, where all agree.
    index.places = (rng.random((n, WALKS, TABLES, SYMBOLS)) * (1.5 * lengths)[:, None, None, None]).astype(np.int64)
    index.tables = np.zeros((n, WALKS, TABLES), U64)
    for a, b in _parts(lengths):
        item = np.arange(a, b)
        index.tables[item] = _sampled(index, index.words, index.first[item], lengths[item], item)
    return index


def _sampled(index: Index, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, item: np.ndarray) -> np.ndarray:
    """windows x WALKS x TABLES hashes of the places sampled for each window's item."""
    places = index.places[item]
    embedded = embed(words, starts, lengths, int(places.max(initial=0)) + 1)
    walk, window = np.arange(WALKS)[None, :, None], np.arange(len(item))[:, None, None]
    out = np.zeros(places.shape[:3], U64)
    for s in range(places.shape[3]):
        out = mix(out * _ODD + embedded[places[:, :, :, s], walk, window])
    return out


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of parts whose windows, as long as the longest of them, have a bounded number of symbols."""
    a = 0
    while a < len(lengths):
        longest = np.maximum.accumulate(lengths[a : a + CHUNK])
        fits = longest * np.arange(1, len(longest) + 1) * WALKS * 3 // 2 <= CHUNK_SYMBOLS
        b = a + max(1, int(fits.argmin()) if not fits.all() else len(fits))
        yield a, b
        a = b


def edit_distances(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, index: Index, item: np.ndarray) -> np.ndarray:
    """Word edits from each item to words[start : e], for the best e up to ``end``."""
    lengths, edits = index.lengths[item], index.edits[item]
    room = np.minimum(ends - starts, lengths + edits)
    width, rows = int(room.max(initial=0)), int(lengths.max(initial=0))
    at = np.arange(width)
    inside = at < room[:, None]
    text = np.where(inside, words[np.where(inside, starts[:, None] + at, 0)], U64(0))
    ramp = np.arange(width + 1, dtype=np.int32)
    row = np.broadcast_to(ramp, (len(item), width + 1)).copy()
    best = np.full(len(item), np.iinfo(np.int32).max, np.int64)
    usable = ramp <= room[:, None]
    for i in range(rows):
        live = i < lengths
        word = np.where(live, index.words[np.where(live, index.first[item] + i, 0)], U64(0))
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (text != word[:, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = lengths == i + 1
        if done.any():
            best[done] = np.where(usable[done], row[done], np.iinfo(np.int32).max).min(axis=1)
    return best


def search(block: Block, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, edits, first word) of each item in each text of a lower-cased block."""
    words, first = _hashed_words(block)
    n = len(words)
    owner = np.repeat(np.arange(block.n), np.diff(first))
    keys = []
    for q, (bits, unique, bounds, item, offset) in index.seeds.items():
        if n < q:
            continue
        grams = _gram(words, q)
        hit = np.flatnonzero(bits[(grams & U64(0xFFFFF)).astype(np.int64)])
        hit = hit[owner[hit] == owner[hit + q - 1]]
        at = np.minimum(np.searchsorted(unique, grams[hit]), len(unique) - 1)
        same = unique[at] == grams[hit]
        hit, at = hit[same], at[same]
        count = bounds[at + 1] - bounds[at]
        entry, hit = ragged(bounds[at], count), np.repeat(hit, count)
        which, k = item[entry], index.edits[item[entry]]
        shift = ragged(-k, 2 * k + 1)
        hit, entry, which = (np.repeat(x, 2 * k + 1) for x in (hit, entry, which))
        start = hit - offset[entry] + shift
        start = np.clip(start, first[owner[hit]], hit)
        keys.append(which * n + start)
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    key = np.unique(np.concatenate(keys))
    which, start = key // n, key % n
    end = first[owner[start] + 1]
    found = []
    for a, b in _parts(index.lengths[which]):
        w, s, e = which[a:b], start[a:b], end[a:b]
        sampled = _sampled(index, words, s, np.minimum(index.lengths[w], e - s), w)
        near = (sampled == index.tables[w]).any(axis=(1, 2))
        w, s, e = w[near], s[near], e[near]
        if len(w):
            edits = edit_distances(words, s, e, index, w)
            ok = edits <= index.edits[w]
            found.append((owner[s[ok]], w[ok], edits[ok], s[ok] - first[owner[s[ok]]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, which, edits, start = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((start, edits, which, text))
    new = np.ones(len(by), bool)
    new[1:] = (text[by][1:] != text[by][:-1]) | (which[by][1:] != which[by][:-1])
    by = by[new]
    return text[by], which[by], edits[by], start[by]


def indexes(benchmark: DataFrame, item_col="item_id", text_col="text", rate: float = RATE, most: int = ITEM_WORDS) -> Iterator[Index]:
    """Indexes of blocks of the benchmark, each of ``most`` words at most (one item at least)."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    ids, texts, size = [], [], 0
    for r in rows.orderBy("id", "text").toLocalIterator():
        n = len(r["text"].split())
        if texts and size + n > most:
            yield build(ids, texts, rate)
            ids, texts, size = [], [], 0
        ids.append(r["id"]), texts.append(r["text"])
        size += n
    if texts:
        yield build(ids, texts, rate)


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", rate: float = RATE, most: int = ITEM_WORDS) -> DataFrame:
    """One row for each document and item that it holds: id, item_id, edits, item_words, first_word."""
    spark = small_batches(docs.sparkSession)
    slim = docs.select(F.col(text_col).cast("string"), id_col)
    schema = f"`{id_col}` {slim.schema[1].dataType.simpleString()}, item_id long, edits long, item_words long, first_word long"
    passes = []
    for index in indexes(benchmark, item_col, item_text_col, rate, most):
        shared = spark.sparkContext.broadcast(index)  # bounded by ``most`` words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for block in blocks(_lowered(batch.column(0)), 1 << 20):
                    text, item, edits, start = search(block, index)
                    ids = batch.column(1).take(pa.array(block.first + text))
                    yield pa.record_batch([ids, *(pa.array(x.astype(np.int64)) for x in (index.ids[item], edits, index.lengths[item], start))], [id_col, "item_id", "edits", "item_words", "first_word"])

        passes.append(slim.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col="text", item_col="item_id", item_text_col="text", rate: float = RATE, most: int = ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item; each row is judged where it is, without a shuffle."""
    spark = small_batches(docs.sparkSession)
    out = docs
    for index in indexes(benchmark, item_col, item_text_col, rate, most):
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts, shared=shared):
            import pandas as pd

            ok = np.ones(len(texts), bool)
            for block in blocks(_lowered(pa.array(texts, pa.large_string(), from_pandas=True)), 1 << 20):
                ok[block.first + search(block, shared.value)[0]] = False
            return pd.Series(ok)

        out = out.where(clean(F.col(text_col).cast("string")))
    return out
