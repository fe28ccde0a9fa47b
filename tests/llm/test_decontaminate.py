import random
import re

import numpy as np
import pyarrow as pa

from quantara.llm import decontaminate as D

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        i = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[i] = f"x{rng.randrange(99)}"
        elif kind == 1:
            w.insert(i, f"x{rng.randrange(99)}")
        elif len(w) > 1:
            del w[i]
    return w


def closest(item, text):
    """Fewest word edits from the item to any run of the text's words."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def brute(docs, items):
    out = {}
    for i, text in docs:
        t = WORD.findall((text or "").lower())
        for k, item in items:
            w = WORD.findall((item or "").lower())
            if len(w) >= D.LEAST and (d := closest(w, t)) <= int(len(w) * D.RATE + 1e-9):
                out[i, k] = d
    return out


def case(seed=13):
    rng = random.Random(seed)
    items = [(k, " ".join(words(rng, rng.randrange(4, 60)))) for k in range(25)] + [(30, None), (31, ""), (32, "Short One"), (33, "É Ünder the Bridge, again! And again")]
    docs = []
    for i in range(160):
        w = words(rng, rng.randrange(0, 150))
        for k in rng.sample(range(25), rng.choice((0, 1, 1, 2))):
            item = items[k][1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = edited(rng, item, rng.randrange(0, 2 + int(len(item) * D.RATE)))
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "x É ÜNDER the-bridge again and AGAIN y"), (503, items[3][1].upper()), (504, (items[4][1] + " ") * 40)]
    return docs, items


def test_matches_brute_force(spark, make_docs):
    docs, items = case()
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, size string")
    want = brute(docs, items)
    for most in (D.ITEM_WORDS, 150):
        got = D.contaminations(make_docs(docs, extra=True), benchmark, most=most).collect()
        found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
        assert len(found) == len(got) and set(found) <= set(want)
        assert all(want[x] <= found[x] for x in found)
        assert len(found) >= 0.99 * len(want)
    clean = D.drop_contaminated(make_docs(docs, extra=True), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in found}


def test_recall_of_the_sampling_at_the_limit():
    rng = random.Random(14)
    for n in (16, 40, 59):
        items = [words(rng, n) for _ in range(300)]
        index = D.build(list(range(300)), [" ".join(x) for x in items])
        texts = [" ".join(edited(rng, x, int(n * D.RATE))) for x in items]
        found = set()
        for block in D.blocks(D._lowered(pa.array(texts))):
            text, item, _, _ = D.search(block, index)
            found |= {(block.first + t, i) for t, i in zip(text.tolist(), item.tolist())}
        assert sum((i, i) in found for i in range(300)) >= 0.99 * 300


def test_embedding_keeps_equal_words_and_is_local():
    rng = np.random.default_rng(15)
    a = rng.integers(1, 2**63, 60, dtype=np.uint64)
    b = a.copy()
    b[50] ^= np.uint64(12345)
    x, y = (D.embed(w, np.array([0]), np.array([60]), 180) for w in (a, b))
    assert (D.embed(a, np.array([0]), np.array([60]), 180) == x).all()
    assert (x[:50] == y[:50]).all() and (x == y).mean() > 0.5


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminations(make_docs([(1, "a b c d e f")]), none).count() == 0
    assert D.contaminations(make_docs([]), some).count() == 0
    assert D.drop_contaminated(make_docs([(1, "a b c d e f"), (2, "b")]), some).count() == 1
