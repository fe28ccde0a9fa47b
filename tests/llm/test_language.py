import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantara.llm import language as L

VOCABULARY = {
    "en": "the of and this that with from have which their would there about".split(),
    "fr": "le la les des est une dans pour avec sur être été cette où".split(),
    "de": "der die das und nicht ist mit für über auch wird straße können".split(),
}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, prose(rng, lang, rng.randrange(4, 60)), lang if i % 7 else None))
    return out


def test_held_out_accuracy_and_edges(make_docs, rows):
    odd = [(1000, None), (1001, ""), (1002, "12 !? 34"), (1003, "日本"), (None, "the of and"), (1004, "der " * 30_000)]
    docs = make_docs([*rows, *odd], extra=True)
    model = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in L.predict(docs, model, keep=("size",)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i]["lang_pred"] == ("en", "fr", "de")[i % 3] and got[i]["score"] > 0.5 for i, _, _ in rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] in model.languages and got[1004]["lang_pred"] == "de"


def test_mixtures(make_docs, rows):
    rng = random.Random(9)
    model = L.fit(make_docs(rows))
    docs = make_docs([(1, prose(rng, "en", 150) + " " + prose(rng, "de", 50)), (2, prose(rng, "fr", 200))])
    both, one = [r["mixture"] for r in L.predict(docs, model).orderBy("doc_id").collect()]
    assert one == "fr:1.000"
    share = dict(x.split(":") for x in both.split())
    assert set(share) == {"en", "de"} and 0.6 < float(share["en"]) < 0.9


def test_training_reads_only_text_and_lang_of_its_rows(make_docs, rows):
    docs = make_docs(rows)
    a = L.fit(docs.where(~L.held_out(F.col("doc_id"))))
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    b = L.fit(other.where(~L.held_out(F.col("doc_id"))))
    assert a.languages == b.languages and np.array_equal(a.logs, b.logs)


def test_nothing_learned(make_docs):
    docs = make_docs([(1, "some text"), (2, None)])
    assert [r["lang_pred"] for r in L.predict(docs, L.fit(docs)).collect()] == ["und", "und"]
    empty = make_docs([])
    assert L.predict(empty, L.fit(empty)).count() == 0


def test_stage_keeps_clean_documents(make_docs, rows):
    docs = make_docs([*rows, (900, None), (901, "123"), (902, "the of and this that")], extra=True)
    out = L.identified(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, _, _ in rows} | {902}


def plain_infer(logs, counts):
    """The penalised mixture by lists and loops: from all languages on, the least one goes while that is worth it."""
    cost, total = 0.5 * L.PENALTY * math.log(sum(counts) + 1), sum(counts)

    def em(chosen, share):
        def mixed(k):
            return sum(s * math.exp(logs[c][k] - top[k]) for s, c in zip(share, chosen))

        for _ in range(L.ROUNDS):
            new = [s / total * sum(n * math.exp(logs[c][k] - top[k]) / mixed(k) for k, n in enumerate(counts)) for s, c in zip(share, chosen)]
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved < L.TOLERANCE:
                break
        return share, sum(n * math.log(mixed(k)) for k, n in enumerate(counts))

    top = [max(column) for column in zip(*logs)]
    chosen = list(range(len(logs)))
    share, fit = em(chosen, [1 / len(logs)] * len(logs))
    while len(chosen) > 1:
        least = max(i for i, s in enumerate(share) if s == min(share))
        rest, left = [c for i, c in enumerate(chosen) if i != least], [s for i, s in enumerate(share) if i != least]
        fewer, fewer_fit = em(rest, [s / sum(left) for s in left])
        if fewer_fit < fit - cost:
            break
        chosen, share, fit = rest, fewer, fewer_fit
    return {c: s / sum(share) for c, s in zip(chosen, share)}


def test_mixtures_against_loops_and_all_sets():
    rng = np.random.default_rng(5)
    for _ in range(30):
        tables = rng.dirichlet([0.3] * 12, size=3) + 1e-4
        logs = np.log(tables / tables.sum(axis=1, keepdims=True))
        true = rng.dirichlet([0.5] * 3)
        counts = rng.multinomial(int(rng.integers(5, 400)), true @ np.exp(logs))
        used = np.flatnonzero(counts)
        got, want = L.infer(logs[:, used], counts[used]), plain_infer(logs[:, used].tolist(), counts[used].tolist())
        assert {k for k in range(3) if got[k] > 0} == set(want)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
        # No set of languages, mixed in steps of a twentieth, has a likelihood that beats the one found by more than its penalty.
        cost = 0.5 * L.PENALTY * math.log(counts.sum() + 1)
        value = lambda share: counts @ np.log(share @ np.exp(logs)) - cost * (share > 0).sum()
        grid = [np.array([a, b, 20 - a - b]) / 20 for a in range(21) for b in range(21 - a)]
        assert value(got) >= max(map(value, grid)) - cost
