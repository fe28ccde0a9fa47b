import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantara.llm import attribution as A
from quantara.llm import tokenfile as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)  # untouched, and no part of the encoder
TEXTS = ["Hello world\n\n\nit's  a test \n é日本\n🙂 x", "", None, "one line", "\n\n", "a\n b\n  c\t\n", "many words " * 3000, "same", "same", "a <|endoftext|> b"]


def library(text):
    e = LIBRARY.encode(text or "", add_special_tokens=False)
    return e.ids, e.offsets


def spans_of_lines(text):
    out, at = [], 0
    for line in (text or "").splitlines(keepends=True) if text else []:
        out.append((at, at + len(line)))
        at += len(line)
    return out


def brute(text, sections, rule):
    counts, crossing = [0.0] * len(sections), [0] * len(sections)
    for s, e in library(text)[1]:
        share = {i: min(e, b) - max(s, a) for i, (a, b) in enumerate(sections) if min(e, b) > max(s, a)}
        if len(share) > 1:
            for i in share:
                crossing[i] += 1
        if not share:
            continue
        if rule == "split":
            for i, x in share.items():
                counts[i] += x / sum(share.values())
        else:
            counts[min(share) if rule == "first" else max(share, key=lambda i: (share[i], -i))] += 1
    return counts, crossing


@pytest.mark.parametrize("rule", A.RULES)
def test_lines_match_the_librarys_offsets(make_docs, rule):
    df = A.section_tokens(make_docs(list(enumerate(TEXTS)), extra=True), PATH, rule=rule)
    got = sorted(map(tuple, df.select("doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing").collect()))
    want = []
    for i, text in enumerate(TEXTS):
        sections = spans_of_lines(text)
        counts, crossing = brute(text, sections, rule)
        want += [(i, k, *sections[k], counts[k], crossing[k]) for k in range(len(sections))]
    assert len(got) == len(want)
    for x, y in zip(got, sorted(want), strict=True):
        assert x == pytest.approx(y)


def test_given_sections(make_docs):
    text = "intro words then body and the ending"
    sections = [(2, 9), (9, 14), (20, 30)]
    docs = make_docs([(1, text), (2, None), (3, "x")]).withColumn("s", F.when(F.col("doc_id") == 1, F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in sections))))
    for rule in A.RULES:
        got = A.section_tokens(docs, PATH, sections_col="s", rule=rule).orderBy("section").collect()
        counts, crossing = brute(text, sections, rule)
        assert [r["n_tokens"] for r in got] == pytest.approx(counts) and [r["n_crossing"] for r in got] == crossing
    with pytest.raises(ValueError):
        A.section_tokens(docs, PATH, rule="none")


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, make_docs, tmp_path, parts):
    docs = make_docs([(i * 7 - 3, t) for i, t in enumerate(TEXTS)] + [(4, "twice"), (4, "twice")], extra=True)
    manifest = T.write_tokens(docs, f"file://{tmp_path}/tokens", PATH, parts=parts, length=64)
    got = list(map(tuple, T.read_tokens(spark, manifest).orderBy("start").collect()))
    want, start = [], 0
    for doc_id, text in sorted([(i * 7 - 3, t or "") for i, t in enumerate(TEXTS)] + [(4, "twice"), (4, "twice")]):
        ids = np.array([*library(text)[0], 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_random_access_is_a_view(spark, make_docs, tmp_path):
    (entry,) = T.write_tokens(make_docs([(1, "many words " * 30_000)]), str(tmp_path / "t"), PATH, parts=1, length=64)
    file = T.TokenFile(entry["path"])
    whole = np.array([*library("many words " * 30_000)[0], 0])
    n = len(whole)
    for i in (0, 5, 100, (n - 1) // 64):
        ids, mask = file.sequence(i)
        assert ids.base is not None and not ids.flags.owndata and len(ids) == 64
        assert (ids[mask] == whole[i * 64 : (i + 1) * 64]).all()
    assert file.masked() == n


def test_empty_table(spark, make_docs, tmp_path):
    manifest = T.write_tokens(make_docs([]), str(tmp_path / "t"), PATH)
    assert manifest == [] and T.read_tokens(spark, manifest).count() == 0
    assert A.section_tokens(make_docs([]), PATH).count() == 0
