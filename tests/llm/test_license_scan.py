import re
from collections import Counter

from quantara.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    files = [words_of(t) for t in texts]
    df = Counter(w for f in files for w in set(f))
    out = []
    for f in files:
        joined = f" {' '.join(f)} "
        at, base = [], set()
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(f)) if f[i : i + len(p)] == p]
            at += hits
            base |= {label} if hits else set()
        labels, best = set(base), L.BASE_SCORE if base else 0.0
        for label, text, must in L.TEMPLATES:
            t = text.split()
            uses = Counter(t)
            rare = sorted(uses, key=lambda w: (df[w], uses[w], w))[: L.ANCHORS]
            votes = {}
            for i, w in enumerate(f):
                if w in rare:
                    for k, x in enumerate(t):
                        if x == w:
                            votes.setdefault(i - k, set()).add(w)
            share = max((len(v) for v in votes.values()), default=0) / len(rare)
            if share >= L.VOTES and all(f" {p} " in joined for p in must):
                labels.add(label)
                best = max(best, share)
        out.append((len(f), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best))
    return out


def test_matches_brute_force(make_docs):
    bsd, mit, apache = (next(t for n, t, _ in L.TEMPLATES if n == x) for x in ("bsd", "mit", "apache"))
    texts = [
        None, "", "...", "plain prose of no licence", "Under the MIT License, MIT license. mit  LICENSE",
        f"x {bsd.upper()} y", f"{mit}\n" * 3, f"été {apache} CC-BY 4.0", mit.replace("free of charge", "gratis"),
        "GNU General Public License, Apache License", "cc by cc by", "of the to and " * 500, "ÀB_c1 mit-license",
        bsd.replace("redistribution", "x"), f"{bsd} {mit}", " ".join(reversed(mit.split())), "mit license " + "z " * 5000 + "apache license",
    ]
    texts += [texts[4]] * 5
    got = L.scan(make_docs(list(enumerate(texts)), extra=True)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts)


def test_empty_table(make_docs):
    assert L.scan(make_docs([])).count() == 0
