"""Language ID by inference of a mixture over languages.

Training counts character n-grams (1 to 3 letters of lower-cased text, runs of other characters being one
blank) of labelled rows by language. The n-grams are hashed to ``BUCKETS`` per order. A document's n-grams
are taken as drawn from a mixture of languages; expectation-maximisation finds the proportions. Languages
are then dropped from the least upwards as long as the penalised likelihood (a BIC whose number of
observations is the n-grams, weighted since they overlap) gains; what stays is the document's language set.

A fixed, documented sample bounds training: about ``SAMPLE`` rows of each language, chosen by a hash of the
id; a language with fewer rows is learned from all of them. Whole texts are read in training and prediction.

Defined results: ``und`` with score 0 for null texts, texts without letters, and where nothing was learned;
a text of letters that no language has gets the language likeliest by smoothing; rows that repeat are
predicted each for itself; an empty table gives an empty result; languages are ordered by code point, ties
go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.llm._bpe import code_points
from quantara.llm._common import small_batches
from quantara.llm._text import U64, Block, blocks, mix

ORDERS = 3
BUCKETS = 1 << 12
#: Rows of each language that training reads.
SAMPLE = 1000
SMOOTHING = 0.1
#: Weight of the BIC penalty of a further language: overlapping n-grams are fewer observations than their number.
PENALTY = 3.0
ROUNDS, TOLERANCE = 40, 1e-4
#: Below this proportion of the likeliest language, or without letters, the pipeline's stage rejects a document.
LEAST_SCORE = 0.4
UNKNOWN = "und"


@cache
def _folding() -> np.ndarray:
    """Lower case of each letter of the BMP, 0x20 for what is no letter."""
    out = np.full(0x10000, 0x20, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and (char := chr(c)).isalpha():
            low = char.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram, and which texts have letters."""
    points, at = code_points(block)
    folded = _folding()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    folded[high] = [ord(c.lower()) if (c := chr(p)).isalpha() and len(c.lower()) == 1 else 0x20 for p in points[high].tolist()]
    texts = np.searchsorted(at, block.bounds)
    owner = np.repeat(np.arange(block.n), np.diff(texts))
    letter = folded != 0x20
    lettered = np.bincount(owner[letter], minlength=block.n) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first blank after a letter
    folded, owner = folded[keep].astype(U64), owner[keep]
    owners, buckets = [], []
    code = np.zeros(len(folded), U64)
    for n in range(1, ORDERS + 1):
        m = len(folded) - n + 1
        if m <= 0:
            break
        code = code[:m] * U64(0x110000) + folded[n - 1 :]
        same = owner[:m] == owner[n - 1 :]
        if n == 1:
            same &= folded != U64(0x20)
        owners.append(owner[:m][same])
        buckets.append((mix(code[same]) % U64(BUCKETS)).astype(np.int64) + (n - 1) * BUCKETS)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    return np.concatenate(owners), np.concatenate(buckets), lettered


def _per_text(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(buckets, counts) of each text, None without letters."""
    owner, bucket, lettered = grams(block)
    by = np.argsort(owner, kind="stable")
    bucket, ends = bucket[by], np.cumsum(np.bincount(owner, minlength=block.n))
    start = 0
    for i, end in enumerate(ends):
        if not lettered[i]:
            yield None
        else:
            counts = np.bincount(bucket[start:end], minlength=ORDERS * BUCKETS)
            found = np.flatnonzero(counts)
            yield found, counts[found]
        start = end


@dataclass(frozen=True)
class Model:
    """log P(n-gram | language), a row a language; each order is a distribution of its own."""

    languages: tuple[str, ...]
    logs: np.ndarray


def fit(labelled: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``labelled`` that have a text and a language."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Model((), np.zeros((0, ORDERS * BUCKETS)))
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < int(min(1.0, sample / n) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                for lang, found in zip(langs[block.first : block.first + block.n], _per_text(block), strict=True):
                    if found:
                        sums.setdefault(lang, np.zeros(ORDERS * BUCKETS, np.int64))[found[0]] += found[1]
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    small_batches(labelled.sparkSession)
    partial = rows.where(chosen).select("text", "lang").mapInArrow(run, "lang string, bucket long, n long")
    totals = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # languages x ORDERS x BUCKETS rows at most
    languages = tuple(sorted({r["lang"] for r in totals}))
    table = np.full((len(languages), ORDERS, BUCKETS), SMOOTHING)
    for r in totals:
        table[languages.index(r["lang"]), r["bucket"] // BUCKETS, r["bucket"] % BUCKETS] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=2, keepdims=True)).reshape(len(languages), -1))


def infer(logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions of the languages (rows of ``logs``) in a text that has its columns' n-grams ``counts`` times."""
    logs = logs - logs.max(axis=0)
    likely = np.exp(logs)
    total = counts.sum()
    cost = 0.5 * PENALTY * np.log(total + 1)

    def em(chosen: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        x, share = likely[chosen], start
        for _ in range(ROUNDS):
            mixed = share @ x
            new = share * (x @ (counts / np.maximum(mixed, 1e-300))) / total
            moved, share = np.abs(new - share).max(), new
            if moved < TOLERANCE:
                break
        return share, float(counts @ np.log(np.maximum(share @ x, 1e-300)))

    chosen = np.arange(len(logs))
    share, fit_ = em(chosen, np.full(len(logs), 1 / len(logs)))
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), len(chosen) - 1 - int(np.argmin(share[::-1])))
        left = share[rest]
        fewer, fewer_fit = em(chosen[rest], left / left.sum() if left.sum() > 0 else np.full(len(rest), 1 / len(rest)))
        if fewer_fit < fit_ - cost:
            break
        chosen, share, fit_ = chosen[rest], fewer, fewer_fit
    out = np.zeros(len(logs))
    out[chosen] = share / share.sum()
    return out


def predict(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of ``docs``: id, the columns ``keep``, lang_pred, score, and the whole mixture as text (``en:0.9 fr:0.1``)."""
    slim = docs.select(F.col(text_col).cast("string"), id_col, *keep)
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)  # languages x ORDERS x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in blocks(batch.column(0)):
                langs, scores, mixtures = [], [], []
                for found in _per_text(block):
                    if found is None or not model.languages:
                        langs.append(UNKNOWN), scores.append(0.0), mixtures.append("")
                        continue
                    share = infer(model.logs[:, found[0]], found[1])
                    best = int(share.argmax())
                    langs.append(model.languages[best]), scores.append(float(min(share[best], 1.0)))
                    mixtures.append(" ".join(f"{model.languages[k]}:{share[k]:.3f}" for k in np.argsort(-share, kind="stable") if share[k] > 0))
                kept = [batch.column(1 + k).slice(block.first, block.n) for k in range(1 + len(keep))]
                yield pa.record_batch([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.string())], [id_col, *keep, "lang_pred", "score", "mixture"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[1:])
    return slim.mapInArrow(run, f"{types}, lang_pred string, score double, mixture string")


def held_out(doc_id):
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with a proportion of ``least`` at least; columns as they are."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        out = []
        for block in blocks(pa.array(texts, pa.large_string(), from_pandas=True)):
            for found in _per_text(block):
                ok = found is not None and bool(shared.value.languages)
                out.append(ok and bool(infer(shared.value.logs[:, found[0]], found[1]).max() >= least))
        return pd.Series(out, dtype=bool)

    return docs.where(known(F.col(text_col).cast("string")))
