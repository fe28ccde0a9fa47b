"""Array kernels over Arrow string columns: words, lines and their hashes, a bounded block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about so many bytes (one text at least), which bounds memory.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Block:
    """Texts ``first`` to ``first + n`` of a batch; text i is data[bounds[i]:bounds[i + 1]]. Null texts are empty here."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    valid: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text in which each of the ascending positions lies."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, self.bounds)))


def blocks(texts: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``most`` bytes, or a single longer text, without copying."""
    for array in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
        if not len(array):
            continue
        _, offsets, data = array.buffers()
        bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        valid = ~np.asarray(array.is_null())
        i = 0
        while i < len(array):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
            yield Block(i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], valid[i:j])
            i = j


def spans(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with ``member[byte]``; runs end with their text."""
    inside = member[block.data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(inside), bool)
    change[0] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    edges = block.bounds[1:-1]
    change[edges[edges < len(inside)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(inside))
    keep = inside[starts]
    return starts[keep], ends[keep]


#: Spans of up to so many bytes are hashed chunk by chunk, all spans at once; longer ones with all their chunks at once.
SHORT = 64
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _at(chunks: np.ndarray, starts: np.ndarray, ends: np.ndarray, k) -> np.ndarray:
    """Chunk k of each span, with zeros behind the span's end."""
    begin = starts + 8 * k
    return chunks[begin] & _TAIL[np.minimum(ends - begin, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand.

    Each chunk of eight bytes goes through a mixer that is no polynomial, so texts of a regular build do not collide.
    """
    chunks, length = _chunks(data), ends - starts
    out = mix(length.astype(U64) + BASE + (U64(seed) << U64(48)))
    live, k = np.flatnonzero((length > 0) & (length <= SHORT)), 0
    while len(live):
        out[live] = mix(out[live] ^ _at(chunks, starts[live], ends[live], k)) * BASE
        live, k = live[length[live] > 8 * k + 8], k + 1
    for part in _long(length):
        count = -(-length[part] // 8)
        of, number = np.repeat(part, count), ragged(np.zeros(len(part), np.int64), count)
        mixed = mix(_at(chunks, starts[of], ends[of], number) ^ mix(number.astype(U64) + BASE + (U64(seed) << U64(48))))
        out[part] = mix(out[part] ^ np.add.reduceat(mixed, np.cumsum(count) - count))
    return out


def _long(length: np.ndarray, most: int = 1 << 23) -> Iterator[np.ndarray]:
    """Numbers of the spans above SHORT, in parts of about ``most`` bytes (one span at least)."""
    long = np.flatnonzero(length > SHORT)
    total = np.cumsum(length[long])
    i = 0
    while i < len(long):
        j = max(i + 1, int(np.searchsorted(total, total[i] - length[long[i]] + most, "right")))
        yield long[i:j]
        i = j


def _same(data, starts, ends, others) -> bool:
    """Whether each span has the bytes of the one that starts at ``others`` and is as long."""
    chunks, length = _chunks(data), ends - starts
    live, k = np.flatnonzero((length > 0) & (length <= SHORT) & (starts != others)), 0
    while len(live):
        if (_at(chunks, starts[live], ends[live], k) != _at(chunks, others[live], others[live] + length[live], k)).any():
            return False
        live, k = live[length[live] > 8 * k + 8], k + 1
    for part in _long(np.where(starts != others, length, 0)):
        count = -(-length[part] // 8)
        of, number = np.repeat(part, count), ragged(np.zeros(len(part), np.int64), count)
        if (_at(chunks, starts[of], ends[of], number) != _at(chunks, others[of], others[of] + length[of], number)).any():
            return False
    return True


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's bytes, a span for each number): equal numbers for equal bytes and for nothing else."""
    _, first, ids = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    one = first[ids]
    if ((ends - starts) == (ends - starts)[one]).all() and _same(data, starts, ends, starts[one]):
        return ids, first
    seen: dict[bytes, int] = {}  # two hashes met: by the bytes themselves
    ids = np.array([seen.setdefault(data[i:j].tobytes(), len(seen)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return ids, np.unique(ids, return_index=True)[1]


def _windows(block: Block, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows of ``width`` words; a text with fewer words has one window of them all."""
    first = np.searchsorted(starts, block.bounds)
    count = np.diff(first)
    left = np.repeat(first[1:], count) - np.arange(len(starts))  # words from here to the text's end
    begins = np.arange(len(starts)) - np.repeat(first[:-1], count) == 0
    at = np.flatnonzero((left >= width) | begins)
    return np.repeat(np.arange(block.n), count)[at], at, np.minimum(left[at], width)


def shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all windows of ``width`` words; a text with fewer words has one window of them all."""
    starts, ends = spans(block, NOT_SPACE)
    words = span_hashes(block.data, starts, ends)
    owner, at, size = _windows(block, starts, width)
    total = np.zeros(len(at), U64)
    for j in range(width):
        inside = size > j
        word = words[np.where(inside, at + j, 0)] if len(words) else words
        total = np.where(inside, mix(total * BASE ^ word), total)
    return owner, total


def exact_shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of all windows; equal numbers for equal words and for nothing else, within this block."""
    starts, ends = spans(block, NOT_SPACE)
    owner, at, size = _windows(block, starts, width)
    if not len(at):
        return owner, at
    words, _ = span_ids(block.data, starts, ends)
    words = words + 1
    number = np.zeros(len(at), np.int64)
    base = int(words.max()) + 1
    for j in range(width):  # numbers stay below windows x words, so they fit
        pair = number * base + np.where(size > j, words[np.minimum(at + j, len(words) - 1)], 0)
        number = np.unique(pair, return_inverse=True)[1]
    return owner, number


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
