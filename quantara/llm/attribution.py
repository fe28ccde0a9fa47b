"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole; the ids' character spans are joined to the sections' spans as
intervals (both sorted, so by binary search), and a token that touches several sections is allocated by an
explicit rule:

- ``most``: to the section that holds most of its characters, the earlier one on a tie;
- ``first``: to the first section that it touches;
- ``split``: in proportion to the characters.

A token of a part of a character counts as that character, like the library's offsets; several tokens of one
character all lie where it lies. Characters in no section count for none.

Defined results: null and empty texts, and documents without sections, have no rows; sections may have gaps
but must ascend and not overlap; rows that repeat are attributed each for itself; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantara.llm._bpe import code_points, encoder
from quantara.llm._common import small_batches
from quantara.llm._text import Block, blocks

RULES = ("most", "first", "split")
SCHEMA = "section int, char_start long, char_end long, n_tokens double, n_crossing long"


def token_spans(block: Block, lengths: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of a block's ids, in the block's characters."""
    _, at = code_points(block)
    ends = np.cumsum(lengths[ids])
    return np.searchsorted(at, ends - lengths[ids], "right") - 1, np.searchsorted(at, ends, "left")


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens [starts, ends) to ascending sections [low, high): (tokens allocated, tokens that touch another section too)."""
    n = len(low)
    a = np.searchsorted(high, starts, "right")  # the first section that ends after the token starts
    b = np.searchsorted(low, ends, "left")  # behind the last that starts before the token ends
    touched = np.maximum(b - a, 0)
    counts = np.bincount(a[touched == 1], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for t in np.flatnonzero(touched > 1):  # few: only tokens across a border
        s = np.arange(a[t], b[t])
        share = np.minimum(high[s], ends[t]) - np.maximum(low[s], starts[t])
        s, share = s[share > 0], share[share > 0]
        if not len(s):
            continue
        if len(s) > 1:
            crossing[s] += 1
        if rule == "split":
            counts[s] += share / share.sum()
        else:
            counts[s[0] if rule == "first" else s[np.argmax(share)]] += 1
    return counts, crossing


def section_tokens(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", sections_col: str | None = None, rule: str = "most") -> DataFrame:
    """One row a section: the id and the columns of SCHEMA.

    ``sections_col``: array<struct<start, end>> in characters; without it, the lines are the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), *([F.col(sections_col).cast("array<struct<start:long,end:long>>").alias("sections")] if sections_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            given = _given(batch.column(2)) if sections_col else None
            for block in blocks(batch.column(1), 1 << 21):
                ids, counts = enc.encode(block)
                points, at = code_points(block)
                texts = np.searchsorted(at, block.bounds)
                starts, ends = token_spans(block, enc.lengths, ids)
                if given is None:
                    owner, low, high = _lines(points, texts)
                else:
                    owner, low, high = given(block.first, block.n)
                    low, high = low + texts[owner], np.minimum(high + texts[owner], texts[owner + 1])
                got, crossing = attribute(starts, ends, low, high, rule)
                number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                columns = [batch.column(0).take(pa.array(block.first + owner)), pa.array(number.astype(np.int32))]
                columns += [pa.array(x.astype(t)) for x, t in ((low - texts[owner], np.int64), (high - texts[owner], np.int64), (got, float), (crossing, np.int64))]
                yield pa.record_batch(columns, [id_col, "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {SCHEMA}")


def _lines(points: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the lines of a block, each with its line break."""
    cuts = np.union1d(texts, np.flatnonzero(points == 0x0A) + 1)
    low, high = cuts[:-1], cuts[1:]
    return np.searchsorted(texts, low, "right") - 1, low, high


def _given(column: pa.Array):
    """Sections of texts ``first`` to ``first + n``; a null list is an empty one."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    low, high = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "end"))
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def part(first: int, n: int):
        at = slice(ends[first], ends[first + n])
        return np.repeat(np.arange(n), sizes[first : first + n]), low[at], high[at]

    return part
