import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quantara.llm import decontaminate, mixing, queries, sharding
from quantara.llm._common import words_count

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


def duck(sql):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    return c.execute(sql).df()


@tables
def test_mix_equals_its_sql(spark):
    got = queries.op8_hash_threshold_mix(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(queries.OP8_SQL).sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.equals(want.astype(got.dtypes))
    assert got.taken.sum() == pytest.approx(1.5 * got["size"].sum(), rel=0.1) and (got.taken <= 2 * got["size"]).all()


@tables
def test_shards_equal_their_sql(spark):
    got = queries.op5_histogram_sort(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(queries.OP5_SQL).sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] == want[c]).all()
    texts = duck("select doc_id, text from documents order by doc_id").text
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in texts]).all()


def test_words_are_counted_like_the_pattern(spark):
    import re

    texts = ["", " ", "a", " a", "a ", " a  b\t\n", "\x0b\x0c", "é\x85b c", "a\x1fb", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(words_count(F.col("text"))).collect()
    assert [r[0] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_edges(make_docs):
    rows = [(1, "a b c", None, "s"), (2, None, None, "s"), (3, "a", None, None), (3, "a", None, None), (None, "a b", None, "t"), (4, "x " * 5000, None, "u"), (5, "", None, "v")]
    df = make_docs(rows, extra=True)
    got = mixing.mix_sources(df)
    assert len(got.columns) == len(set(got.columns)) and got.count() == len(rows)
    assert all(0 <= r["copies"] <= 2 and (r["size"] or not r["copies"]) for r in got.collect())
    taken = mixing.take_mix(df)
    assert taken.columns == df.columns
    assert mixing.take_mix(make_docs([])).count() == 0


def targets(sizes, share=1.5, cap=2.0):
    """The excess over the caps is dealt again by weight until none is above."""
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_match_the_iteration(make_docs):
    rows, i = [], 0
    for s, n in (("a", 3), ("b", 40), ("c", 500), ("d", 9), (None, 77), ("e", 1)):
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 13), None, s))
            i += 1
    got = mixing.mix_sources(make_docs(rows)).collect()
    sizes = defaultdict(int)
    for r, row in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        sizes[row[3]] += r["size"]
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 13 for s in want)


def shard_brute(rows, shards=sharding.SHARDS):
    import hashlib

    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    keyed = [(md5(t or ""), md5("" if i is None else i), len((t or "").encode()) + 1) for i, t in rows]
    total, groups = sum(k[2] for k in keyed), Counter()
    for h, _, n in keyed:
        groups[h] += n
    unit = lambda k: (k[0], k[1] if groups[k[0]] > sharding.WHOLE * total / shards else "")
    before, sums = {}, Counter()
    for k in keyed:
        sums[unit(k)] += k[2]
    done = 0
    for u in sorted(sums):
        before[u], done = done, done + sums[u]
    return [before[unit(k)] * shards // total for k in keyed]


def test_shards_with_a_hot_text(make_docs):
    rows = [(i, f"text {i}" * (1 + i % 7)) for i in range(300)] + [(1000 + i, "hot text " * 9) for i in range(200)] + [(1000, "hot text " * 9), (None, None), (5000, ""), (5001, "long " * 9000)]
    df = make_docs(rows, extra=True)
    got = sharding.shard_documents(df, out=("n_bytes", "part", "place")).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], s) for r, s in zip(rows, shard_brute(rows), strict=True))
    assert Counter((r["doc_id"], r["part"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["part"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(make_docs([])).count() == 0


@tables
def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "source_mix", "sharding"]
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "sharding":
            assert docs.columns == columns
        if name == "decontamination":
            gone = {r["doc_id"] for r in decontaminate.contaminations(before, benchmark).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - gone
    assert {r["shard"] for r in docs.collect()} == set(range(8))


@tables
def test_pipeline_is_registered(spark):
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b
