"""Quality rules from a suffix array of each text.

Per text, a suffix array over its words is built by prefix doubling (blocks of texts at once, the text's
number being the first sort key). Neighbours' longest common prefixes give, for each word position, the
longest substring starting there that occurs elsewhere in the text, that is the value of the deepest
LCP interval that holds the suffix. Substrings that cannot be extended to the left either are the maximal
repeats; those of ``min_words`` or more are united, and the share of words they cover and the longest of
them are limited.

Defined results: null and empty texts have no words and fail the base rule; texts of any length are read
whole; rows are independent, so repeated rows and ids give repeated results; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantara.llm._common import small_batches
from quantara.llm._text import NOT_SPACE, Block, blocks, span_ids, spans

#: Repeats shorter than this occur by chance in clean prose.
MIN_WORDS = 6
MAX_COVERED = 0.40
#: The longest repeat may have this share of the words, and LONGEST_FREE words anyway.
MAX_LONGEST = 0.20
LONGEST_FREE = 40

#: Up to so many common prefixes are followed one by one, in slices, others side by side.
FEW = 64

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NOT_BREAK = np.ones(256, bool)
NOT_BREAK[0x0A] = False

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, n_maximal_repeats long, kept boolean"


def suffix_array(symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP with the suffix before, of many texts at once.

    ``symbols`` must differ between texts; ``last[i]`` is the index after the end of i's text.
    Sorting stops for suffixes whose place is known, so the cost follows what repeats.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    step = 1
    while True:
        # Slots of suffixes that share their rank with another.
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        ahead = at + step
        inside = ahead < last[at]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        by = np.lexsort((second, rank[at]))
        at, second, first = at[by], second[by], rank[at][by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        fresh[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        step *= 2
    return order, _common_prefixes(symbols, last, order, rank)


def _common_prefixes(symbols: np.ndarray, last: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP of each suffix in the array with the one before, without any table of ranks.

    From a position to the next one a common prefix shrinks by one at most (Kasai et al.). So only prefixes that do not
    come from the position before, the irreducible ones (another symbol precedes the two suffixes), are measured, which
    together take n log n steps at most; the others are their rest.
    """
    n = len(symbols)
    before = np.full(n, -1)
    before[rank[order[1:]]] = order[:-1]  # slot -> the suffix in the slot before
    other = before[rank]
    other = np.where((other >= 0) & (symbols[np.maximum(other, 0)] == symbols), other, -1)
    back, back_other = np.arange(n) - 1, other - 1
    reducible = (back >= 0) & (back_other >= 0) & (other >= 0)
    reducible[reducible] = symbols[back[reducible]] == symbols[back_other[reducible]]
    at = np.flatnonzero((other >= 0) & ~reducible)
    length = np.zeros(n, np.int64)
    live, a, b, end = at, at.copy(), other[at], last[at]
    while len(live) > FEW:
        go = (a < end) & (b < end)
        go[go] = symbols[a[go]] == symbols[b[go]]
        live, a, b, end = live[go], a[go] + 1, b[go] + 1, end[go]
        length[live] += 1
    for i, x, y, e in zip(live.tolist(), a.tolist(), b.tolist(), end.tolist(), strict=True):
        size = 64
        while room := min(size, e - x, e - y):
            unlike = np.flatnonzero(symbols[x : x + room] != symbols[y : y + room])
            same = int(unlike[0]) if len(unlike) else room
            length[i] += same
            x, y, size = x + same, y + same, min(2 * size, 1 << 20)
            if len(unlike):
                break
    # A reducible prefix ends where that of the last irreducible one before it does.
    source = np.maximum.accumulate(np.where(reducible, -1, np.arange(n)))
    length = np.where(reducible, length[source] - (np.arange(n) - source), length)
    lcp = np.zeros(n, np.int64)
    lcp[rank] = np.where(other >= 0, length, 0)
    return lcp


def longest_repeats(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that occurs elsewhere in its text."""
    order, lcp = suffix_array(symbols, last)
    most = np.zeros(len(symbols), np.int64)
    most[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return most


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in a span."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta)[:n] > 0


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def measure(block: Block, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST, longest_free: int = LONGEST_FREE) -> dict[str, np.ndarray]:
    starts, ends = spans(block, NOT_SPACE)
    first = np.searchsorted(starts, block.bounds)
    n_words = np.diff(first)
    points = ((block.data & 0xC0) != 0x80) & NOT_SPACE[block.data]
    n = len(starts)
    owner = np.repeat(np.arange(block.n), n_words)
    ids, _ = span_ids(block.data, starts, ends)
    most = longest_repeats(owner * (int(ids.max(initial=0)) + 1) + ids, np.repeat(first[1:], n_words))
    at = np.flatnonzero(most >= 3)
    threes = _covered(at, np.full(len(at), 3), n)
    left = np.zeros(n, np.int64)  # what the position before repeats, in the same text
    left[1:] = np.where(owner[1:] == owner[:-1], most[:-1], 0)
    maximal = np.flatnonzero((most >= min_words) & (left <= most))
    covered = _per_text(_covered(maximal, most[maximal], n), first)
    longest = np.zeros(block.n, np.int64)
    np.maximum.at(longest, owner, most)
    repeats = _per_text(threes, first)
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    too_long = longest > np.maximum(max_longest * n_words, longest_free)
    return {
        "n_words": n_words,
        "word_chars": _per_text(points, block.bounds),
        "n_symbols": _per_text(SYMBOL[block.data], block.bounds),
        "n_dup_lines": _duplicate_lines(block, starts),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "covered_words": covered,
        "longest_repeat": longest,
        "n_maximal_repeats": np.bincount(owner[maximal], minlength=block.n),
        "kept": ~failed & (covered <= max_covered * n_words) & ~too_long,
    }


def _duplicate_lines(block: Block, word_starts: np.ndarray) -> np.ndarray:
    starts, ends = spans(block, NOT_BREAK)
    worded = np.searchsorted(word_starts, starts) < np.searchsorted(word_starts, ends)
    starts, ends = starts[worded], ends[worded]
    owner, line = block.owner(starts), span_ids(block.data, starts, ends)[0]
    by = np.lexsort((line, owner))
    again = (line[by][1:] == line[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    return np.bincount(owner[by][1:][again], minlength=block.n)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row a document: the id and the columns of SCHEMA."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = measure(block, **limits)
                ids = batch.column(0).slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[x]) for x in names)], [id_col, *names])

    small_batches(docs.sparkSession)
    slim = docs.select(id_col, docs[text_col].cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {SCHEMA}")
