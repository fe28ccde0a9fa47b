"""Byte-level BPE of whole texts with the tokenizers library, each distinct pre-token encoded once.

BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row. Texts are split here
with array operations by the pattern of the vocabulary; the library encodes the pre-tokens not seen yet,
and the ids of all others come from a bounded memo, which knows a pre-token by two hashes and the number of
its bytes. Texts with characters whose class depends on the Unicode version, or with the string of an added
token (which the library takes for that token), are given to the library whole.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from quantara.llm._text import Block, ragged, span_hashes, span_ids

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
#: Distinct pre-tokens kept; beyond it the memo starts anew.
MEMO = 2_000_000
#: Pre-tokens encoded in one string.
ROW = 1000

# The contractions that the pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# Unicode's White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """The pattern's class of each code point; UNSURE where Unicode 3.2 and the current one disagree."""
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, UNSURE, np.uint8)
    for c in range(0x30000):
        char = chr(c)
        old, new = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
        if old != "Cn" and kind.get(old[0], OTHER) == kind.get(new[0], OTHER):
            out[c] = kind.get(new[0], OTHER)
    out[0x180E] = UNSURE
    out[list(WHITE_SPACE)] = SPACE
    return out


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block, and the byte at which each starts (with the end appended)."""
    if len(block.data) and block.data.max() < 0x80:
        return block.data.astype(np.uint32), np.arange(len(block.data) + 1)
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((block.data & 0xC0) != 0x80)
    return points, np.append(at, len(block.data))


def pre_token_starts(points: np.ndarray, kinds: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; ``texts``: starts of the texts, in code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[texts] = True
    run = first[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    blank = points == 0x20
    start = run.copy()
    # A run that is no white space takes the blank before it along; of other white space before it, the last is alone.
    word = np.flatnonzero(run & (kinds != SPACE) & ~first[:n])
    after_space = word[kinds[word - 1] == SPACE]
    start[after_space - 1] = True
    start[after_space[blank[after_space - 1]]] = False
    # Contractions: a lone apostrophe at a pre-token's start, then the letters.
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[run[quote + 1] & ~first[quote + 1] & (kinds[quote + 1] == LETTER)]
    if len(quote):
        one, two = points[quote + 1], np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(first[np.minimum(quote + 2, n)], 0, two)
        for c in CONTRACTIONS:
            hit = quote[(one == ord(c[1])) & ((two == ord(c[2])) if len(c) == 3 else True)]
            start[hit + 1] = False
            after = hit + len(c)
            after = after[(after < n)]
            start[after[(kinds[after] == LETTER) & ~first[after]]] = True
    return np.flatnonzero(start)


class Encoder:
    """``encode(block)``: the ids of a block's texts, with their byte spans if wanted."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [np.frombuffer(t.content.encode(), np.uint8) for t in added.values()]
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # in bytes: one for each character of the byte-level form
        self.lengths[list(vocab.values())] = [*map(len, vocab)]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by key
        self.checks = np.zeros(0, np.uint64)  # by slot: a second hash
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # by slot
        self.ids, self.used = np.zeros(4096, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array) // 2), array.dtype)])

    def _learn(self, keys: np.ndarray, checks: np.ndarray, data: bytes, low: np.ndarray, high: np.ndarray, joins: np.ndarray) -> None:
        """Encode pre-tokens. Those of a blank and letters (``joins``) keep apart in a row, so they are encoded in rows."""
        by = np.argsort(~joins, kind="stable")
        keys, checks, low, high = keys[by], checks[by], low[by], high[by]
        self.checks = np.concatenate([self.checks, checks])
        n = int(joins.sum())
        words = [data[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]
        rows = [b"".join(words[i : min(i + ROW, n)]).decode() for i in range(0, n, ROW)] + [w.decode() for w in words[n:]]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        flat = np.fromiter((i for x in found for i in x), self.ids.dtype, sum(map(len, found)))
        # Ids spell the bytes of the rows, so a pre-token's first id is where its first byte is.
        ends = np.searchsorted(np.cumsum(self.lengths[flat]), np.cumsum(high - low)) + 1
        counts = np.diff(ends, prepend=0)
        k = len(self.slots)
        self.starts, self.counts = self._room(self.starts, k + len(keys)), self._room(self.counts, k + len(keys))
        self.ids = self._room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[k : k + len(keys)] = self.used + ends - counts
        self.counts[k : k + len(keys)] = counts
        self.used += len(flat)
        keys, slots = np.concatenate([self.keys, keys]), np.arange(k, k + len(keys))
        slots = np.concatenate([self.slots, slots])
        by = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[by], slots[by]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has). Each id stands for ``lengths[id]`` bytes."""
        points, at = code_points(block)
        kinds = classes()[points]
        texts = np.searchsorted(at, block.bounds)
        unsure = np.zeros(block.n, bool)
        odd = np.flatnonzero(kinds == UNSURE)
        unsure[np.searchsorted(texts, odd, "right") - 1] = True
        unsure[np.searchsorted(block.bounds, self._added_at(block), "right") - 1] = True
        starts = pre_token_starts(points, kinds, texts[:-1])
        of = np.searchsorted(texts, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(points)), texts[of + 1])
        if unsure.any():
            sure = ~unsure[of]
            starts, of, ends = starts[sure], of[sure], ends[sure]
        low, high = at[starts], at[ends]
        back, first = span_ids(block.data, low, high)
        keys = span_hashes(block.data, low[first], high[first])
        checks = span_hashes(block.data, low[first], high[first], seed=1)
        if len(self.keys) > MEMO:
            self._forget()
        new = np.flatnonzero(~self._known(keys))
        if len(new):
            begin = starts[first[new]]
            joins = (points[begin] == 0x20) & (kinds[np.minimum(begin + 1, len(points) - 1)] == LETTER) & (high - low > 1)[first[new]]
            self._learn(keys[new], checks[new], block.data.tobytes(), low[first[new]], high[first[new]], joins)
        slots = self.slots[np.searchsorted(self.keys, keys)]
        met = self.checks[slots] != checks  # another pre-token has the same first hash
        if met.any():
            return self._one_by_one(block)
        counts = self.counts[slots][back]
        ids = self.ids[ragged(self.starts[slots][back], counts)]
        per_text = np.bincount(of, counts, block.n).astype(np.int64)
        if unsure.any():
            ids, per_text = self._whole(block, unsure, ids, per_text)
        return ids, per_text

    def _added_at(self, block: Block) -> np.ndarray:
        """Bytes at which the string of an added token starts."""
        found = []
        for token in self.added:
            at = np.flatnonzero(block.data[: max(0, len(block.data) - len(token) + 1)] == token[0])
            for k in range(1, len(token)):
                at = at[block.data[at + k] == token[k]] if len(at) else at
            found.append(at)
        return np.concatenate([*found, np.zeros(0, np.int64)])

    def _one_by_one(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All texts by the library."""
        none = np.zeros(0, np.uint32), np.zeros(block.n, np.int64)
        return self._whole(block, np.ones(block.n, bool), *none)

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return known

    def _whole(self, block: Block, unsure: np.ndarray, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put in the ids of texts that the library gets whole."""
        which = np.flatnonzero(unsure)
        data, b = block.data.tobytes(), block.bounds
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch([data[b[i] : b[i + 1]].decode() for i in which], add_special_tokens=False)]
        parts, ends = [], np.cumsum(per_text)
        done = 0
        for i, x in zip(which, found, strict=True):
            parts += [ids[done : ends[i]], x]
            done = ends[i]
        per_text = per_text.copy()
        per_text[which] = [len(x) for x in found]
        return np.concatenate([*parts, ids[done:]]), per_text


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)
