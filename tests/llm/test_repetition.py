import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quantara.llm import repetition as R
from quantara.llm._text import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    windows = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    marked = {j for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    most = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                most[i] = max(most[i], k)
    covered = {j for i in range(n) if most[i] >= R.MIN_WORDS for j in range(i, i + most[i])}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": dup,
        "n_repeat_words": len(marked),
        "covered_words": len(covered),
        "longest_repeat": max(most, default=0),
    }


def measured(texts, most=1 << 20):
    out = []
    for block in blocks(pa.array(texts, pa.string()), most):
        got = R.measure(block)
        out += [{k: v[i] for k, v in got.items()} for i in range(block.n)]
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#\n\t\x85", max_size=60)), max_size=6))
def test_measures_match_brute_force(texts):
    for most in (1 << 20, 20):
        for text, got in zip(texts, measured(texts, most), strict=True):
            assert {k: got[k] for k in brute(text)} == brute(text)


def test_long_and_periodic_text():
    text = "a b c " * 3000
    (got,) = measured([text])
    assert got["longest_repeat"] == 8997 and got["covered_words"] == 9000 and not got["kept"]


def test_verdicts():
    rng = np.random.default_rng(1)
    clean = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 400))
    passage = " ".join(f"p{x}" for x in range(150))
    a, b, c = measured([clean, f"{passage} {clean} {passage}", "few words"])
    assert a["kept"] and not a["base_failed"]
    assert not b["kept"] and not b["base_failed"] and b["longest_repeat"] == 150
    assert c["base_failed"] and not c["kept"]


def test_query_over_table(make_docs):
    rows = [(1, None), (2, ""), (3, "x " * 60), (3, "x " * 60), (4, "ü" * 10)]
    got = sorted(map(tuple, R.quality(make_docs(rows, extra=True)).select("doc_id", "n_words", "kept").collect()))
    assert got == [(1, 0, False), (2, 0, False), (3, 60, False), (3, 60, False), (4, 1, False)]
    assert R.quality(make_docs([])).count() == 0


def test_suffix_arrays_of_small_texts():
    r = random.Random(2)
    for _ in range(200):
        texts = [[r.randrange(r.choice((1, 2, 5))) for _ in range(r.randrange(25))] for _ in range(r.randrange(1, 5))]
        sizes = [len(x) for x in texts]
        if not sum(sizes):
            continue
        symbols = np.array([i * 10 + c for i, x in enumerate(texts) for c in x])
        last = np.repeat(np.cumsum(sizes), sizes)
        order, lcp = R.suffix_array(symbols, last)
        suffixes = [tuple(symbols[i : last[i]]) for i in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(order)):
            common = next((m for m, (a, b) in enumerate(zip(suffixes[k - 1], suffixes[k])) if a != b), min(len(suffixes[k - 1]), len(suffixes[k])))
            assert lcp[k] == common


def test_kept_and_maximal_repeats_against_brute_force():
    r = random.Random(3)
    texts = []
    for _ in range(60):
        w = [f"w{r.randrange(40)}" for _ in range(r.randrange(1, 160))]
        for _ in range(r.randrange(3)):
            i, n = r.randrange(len(w)), r.randrange(60)
            w[r.randrange(len(w)) : 0] = w[i : i + n]
        texts.append(" ".join(w))
    (block,) = blocks(pa.array(texts))
    got = R.measure(block)
    for t, text in enumerate(texts):
        w = text.split()
        most = [max((next((m for m in range(len(w)) if max(i, j) + m >= len(w) or w[i + m] != w[j + m]), 0) for j in range(len(w)) if j != i), default=0) for i in range(len(w))]
        starts = [i for i in range(len(w)) if most[i] >= R.MIN_WORDS and (i == 0 or most[i - 1] <= most[i])]
        covered = len({k for i in starts for k in range(i, i + most[i])})
        longest = max(most, default=0)
        threes = len({k for i in range(len(w)) if most[i] >= 3 for k in range(i, i + 3)})
        failed = len(w) < 50 or 100 * threes > 50 * len(w)
        kept = not failed and covered <= R.MAX_COVERED * len(w) and longest <= max(R.MAX_LONGEST * len(w), R.LONGEST_FREE)
        assert (got["n_maximal_repeats"][t], got["covered_words"][t], got["longest_repeat"][t], got["base_failed"][t], got["kept"][t]) == (len(starts), covered, longest, failed, kept)


def test_lines_that_only_a_polynomial_confuses():
    a = "0"
    while len(a) < 4096:
        a += a.translate(str.maketrans("01", "10"))
    b = a.translate(str.maketrans("01", "10"))
    (block,) = blocks(pa.array([f"{a}\n{b}", f"{a}\n{a}"]))
    assert R.measure(block)["n_dup_lines"].tolist() == [0, 1]
