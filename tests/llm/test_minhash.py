import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantara.llm import minhash as M
from quantara.llm._text import blocks
from quantara.llm.components import components


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    a, b = bag(a), bag(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def words(rng, n, vocabulary=500):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_signatures_are_unbiased():
    rng = random.Random(3)
    base = words(rng, 200, 3)
    texts = [" ".join(base), " ".join(base[:150] + words(rng, 50, 3)), " ".join(base[:60] * 3)]
    (block,) = blocks(pa.array(texts))
    s = M.signatures(*M.multisets(block), block.n, 4096)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert (s[i] == s[j]).mean() == pytest.approx(jaccard(texts[i], texts[j]), abs=0.035)


def test_signatures_do_not_depend_on_the_block():
    rng = random.Random(4)
    texts = [" ".join(words(rng, n)) for n in (1, 3, 5, 6, 50, 400)] + ["", None, "a " * 500]
    whole = np.concatenate([M.signatures(*M.multisets(b), b.n, 192) for b in blocks(pa.array(texts))])
    single = np.concatenate([M.signatures(*M.multisets(b), b.n, 192) for b in blocks(pa.array(texts), 1)])
    assert (whole == single).all() and np.isinf(whole[[6, 7]]).all() and np.isfinite(whole[:6]).all()


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if s is not None and t is not None and (s == t or jaccard(s, t) >= M.SIMILARITY):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def corpus():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice((4, 30, 120, 300)))
        for _ in range(rng.choice((1, 2, 6, 14))):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(w))
    shared = words(rng, 120)  # alike below the threshold
    rows += [" ".join(shared + words(rng, 60, 10**6)) for _ in range(15)]
    rows += ["", "", "  ", None, None, "a b", "a b", "a c", "z " * 900, "z " * 890]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_match_brute_force(make_docs):
    rows = corpus()
    got = M.near_duplicates(make_docs(rows, extra=True)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows) and len(got) == len(rows)


def test_residual_links_are_found(make_docs):
    """A chain in which neighbours are alike, but not to the smallest member."""
    rng = random.Random(6)
    w = words(rng, 300, 10**6)
    rows = [(0, " ".join(w))]
    for k in range(1, 12):
        w = w[8:] + words(rng, 8, 10**6)
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows) == dict.fromkeys(range(12), 0)


def test_drop_keeps_one_of_each(make_docs):
    rows = [(5, "same text here"), (3, "same text here"), (3, "same text here"), (None, "same text here"), (7, None), (8, "other")]
    df = make_docs(rows, extra=True)
    out = M.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"]) for r in out.collect())) == [(False, 3), (False, 7), (False, 8), (True, None)]
    empty = make_docs([])
    assert M.drop_near_duplicates(empty).count() == 0 and M.near_duplicates(empty).count() == 0


def test_unlike_texts_of_one_id_stay(make_docs):
    rows = [(5, "alpha beta gamma"), (5, "delta epsilon zeta"), (3, "same text"), (5, "same text"), (5, "a unique text here"), (5, "a unique text here")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        out = M.drop_near_duplicates(make_docs(rows, extra=True)).collect()
        want = [(3, "same text"), (5, "a unique text here"), (5, "alpha beta gamma"), (5, "delta epsilon zeta")]
        assert sorted((r["doc_id"], r["text"]) for r in out) == want
    kept = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in M.near_duplicates(make_docs(rows)).collect())
    assert kept == [(3, 3, True), (5, 3, False), *[(5, 5, True)] * 4]


def test_blocks_of_any_size_lose_no_link(make_docs, monkeypatch):
    monkeypatch.setattr(M, "GROUP_BLOCK", 3)
    monkeypatch.setattr(M, "COLUMNS", 5)
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(make_docs(rows)).collect()}
    assert got == brute_classes(rows)


def test_shingles_that_only_a_polynomial_confuses():
    a = "0"
    while len(a) < 4096:
        a += a.translate(str.maketrans("01", "10"))
    b = a.translate(str.maketrans("01", "10"))
    assert M.similarities(pa.array([a, a, f"x {a}"]), pa.array([b, a, f"x {b}"])).tolist() == [0, 1, 0]


def test_components_of_a_long_path_and_stars(spark):
    rng = random.Random(7)
    order = rng.sample(range(60), 60)
    links = list(zip(order, order[1:])) + [(100, x) for x in range(101, 130)] + [(300, 300)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 130), 100)}
