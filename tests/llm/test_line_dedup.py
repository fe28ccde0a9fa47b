import random
import re
from collections import Counter

from quantara.llm import line_dedup as D


def normal(line):
    return " ".join(re.findall(r"[^\W\d_]+", line.lower()))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    """Edits of words, or of characters where a line is short."""
    if min(len(a), len(b)) >= D.SIMILARITY * D.SHORT:
        a, b = a.split(), b.split()
    n = max(len(a), len(b))
    return min(len(a), len(b)) >= D.SIMILARITY * n and edits(a, b) <= int((1 - D.SIMILARITY) * n + 1e-9)


def prints(spark, lines):
    """Which lines may be alike by their fingerprints: their length, keys and short fingerprint."""
    df = spark.createDataFrame(list(enumerate(lines)), "name int, norm string").selectExpr("*", "split(norm, ' ') as words")
    return {lines[r["name"]]: (set(r["keys"]), r["sim"] & (2**64 - 1), r["size"] >= D.SIMILARITY * D.SHORT) for r in D._fingerprints(df).collect()}


def candidates(a, b):
    return bool(a[0] & b[0]) and (a[2] != b[2] or (a[1] ^ b[1]).bit_count() <= D.DISTANCE)


def brute(spark, docs):
    """All pairs of distinct lines that share a block, are within DISTANCE and have the edit similarity; the first occurrence of each group stays."""
    first = {}
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if n := normal(line):
                first.setdefault(n, (i, k))
    lines = list(first)
    sim = prints(spark, lines)
    parent = {n: n for n in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[:k]:
            if candidates(sim[a], sim[b]) and alike(a, b):
                x, y = sorted((find(a), find(b)), key=first.get)
                parent[y] = x
    out = []
    for i, text in docs:
        if text is None or i is None:
            out.append((i, text))
        else:
            out.append((i, "\n".join(line for k, line in enumerate(text.split("\n")) if not normal(line) or first[find(normal(line))] == (i, k))))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    base = [[word() for _ in range(rng.choice((3, 12, 40, 90)))] for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            w = list(rng.choice(base))
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = [word() for _ in range(20)]
            lines.append(" ".join(w) + rng.choice(("", ".", " !", f" {rng.randrange(10)}")))
        docs.append((i, "\n".join(lines)))
    return [*docs, (50, None), (51, ""), (52, "\n\n--\n"), (53, "Page 1 of 9\nPage 2 of 8"), (None, "Page 1 of 9"), (61, "Page 1 of 9\nsomething else"), (7, "one line\nof its own id"), (60, "1 2 3\n1 2 3"), (54, "word " * 20_000), (55, "word " * 20_000 + "x")]


def test_matches_brute_force(spark, make_docs):
    docs = corpus()
    small = [d for d in docs if d[1] is None or len(d[1]) < 50_000]
    got = D.dedup_lines(make_docs(small, extra=True))
    assert {"size", "kept", "n_lines", "n_dropped"} < set(got.columns)
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(brute(spark, small))
    for r in rows:
        assert r["n_lines"] - r["n_dropped"] == (len(r["text"].split("\n")) if r["text"] is not None and (r["text"] or not r["n_dropped"]) else r["n_lines"] - r["n_dropped"])


def test_long_lines_and_repeated_rows(make_docs):
    got = D.dedup_lines(make_docs([(54, "word " * 20_000), (55, "word " * 20_000 + "x"), (56, "a b"), (56, "a b"), (57, "A, b")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], len(r["text"])) for r in got] == [(54, 100_000), (55, 0), (56, 3), (56, 3), (57, 0)]


def test_empty_table(make_docs):
    assert D.dedup_lines(make_docs([])).count() == 0


def test_unlike_texts_of_one_id(make_docs):
    docs = [(56, "alpha beta\nunique line here"), (56, "something else\nalpha beta"), (56, "something else\nalpha beta")]
    for turn in range(3):
        got = D.dedup_lines(make_docs(docs[turn:] + docs[:turn])).collect()
        lines = Counter(line for r in got for line in r["text"].split("\n"))
        assert lines["unique line here"] == 1 and lines["something else"] == 2 and lines["alpha beta"] in (1, 2)


def test_changed_words_leave_blocks_whole(spark):
    """The pigeonhole principle of the blocks: a changed word disturbs the few next to it in hash order only."""
    rng = random.Random(12)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}xyz" for i in range(400)]
    lines = []
    for _ in range(200):
        w = rng.sample(words, 40)
        lines.append((" ".join(w), " ".join([*w[:-1], "changed"])))
    got = prints(spark, sorted({x for pair in lines for x in pair}))
    shared = [len(got[a][0] & got[b][0]) for a, b in lines]
    assert min(shared) >= 2 and sum(shared) / len(shared) > 5


def edited(rng, line, scattered):
    """``line`` after edits up to the limit: of words (of characters in short lines) at places of their own, or in a row."""
    by_words = len(line) >= D.SHORT
    parts = line.split() if by_words else list(line)
    k = rng.randint(1, max(1, len(parts) // 10))
    for p in sorted(rng.sample(range(len(parts)), k) if scattered else range(p := rng.randrange(len(parts) - k + 1), p + k), reverse=True):
        new = "".join(rng.choice("ijklmnop") for _ in range(6 if by_words else 1))
        how = rng.randrange(3) if scattered else 0
        parts[p : p + 1] = [new] if how == 0 else [parts[p], new] if how == 1 else []
    return normal((" " if by_words else "").join(parts))


def test_recall_by_length_against_edit_similarity_alone(spark, make_docs):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    docs, pairs = [], {}
    for words in ((2, 10), (10, 20), (20, 40), (40, 80), (80, 120)):
        for i in range(120):
            a = " ".join(word() for _ in range(rng.randrange(*words)))
            if len(a) < 10:
                continue
            b = edited(rng, a, i % 2)
            if a != b and alike(a, b):
                pairs.setdefault(words, []).append((len(docs), len(docs) + 1))
                docs += [(len(docs), a), (len(docs) + 1, b)]
    got = {r["doc_id"]: r["n_dropped"] for r in D.dedup_lines(make_docs(docs)).collect()}
    for words, both in pairs.items():
        assert len(both) > 80
        assert sum(got[b] for _, b in both) >= 0.9 * len(both), words
    texts = dict(docs)
    for b in (i for i, n in got.items() if n):
        assert any(alike(texts[a], texts[b]) for a in texts if a < b and 0.9 <= len(texts[a]) / len(texts[b]) <= 1 / 0.9 and (a == b - 1 or len(texts[b]) < 60))


def test_a_passage_in_many_lines_makes_few_pairs(monkeypatch, make_docs, spark):
    """Lines that share a long passage and are not alike are not held against each other one by one; near ones among them
    are found all the same."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9)))
    passage, docs = [word() for _ in range(60)], []
    for i in range(150):
        own = [word() for _ in range(12)]
        at = rng.randrange(13)
        line = own[:at] + passage + own[at:]
        docs.append((2 * i, " ".join(line)))
        if i % 5 == 0:
            line[rng.randrange(len(line))] = word()
            docs.append((2 * i + 1, " ".join(line)))
    held, verified = [], D._verified
    monkeypatch.setattr(D, "_verified", lambda pairs, *rest: held.append(pairs.count()) or verified(pairs, *rest))
    got = Counter((r["doc_id"], r["text"]) for r in D.dedup_lines(make_docs(docs)).collect())
    assert got == Counter(brute(spark, docs))
    assert sum(text == "" for _, text in got.elements()) >= 25
    assert sum(held) < 2_000  # of 16,110


def test_bags_lose_no_pair(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 9)))
    pairs = []
    for i in range(300):
        a = " ".join(word() for _ in range(rng.randrange(2, 12)))[:79].strip()
        b = edited(rng, a, i % 2) if len(a) < D.SHORT else a
        pairs.append((a, b, max(len(a), len(b)), abs(len(a) - len(b)), edits(a, b)))
    pairs += [("e" * 70, "e" * 64 + "x" * 6, 70, 0, 6)]
    df = spark.createDataFrame(pairs, "a string, b string, size int, more int, edits int")
    rows = df.select("*", D._bags_apart(D._bag("a"), D._bag("b")).alias("apart")).collect()
    assert all(r["apart"] + r["more"] <= 2 * r["edits"] for r in rows) and any(r["apart"] for r in rows)
