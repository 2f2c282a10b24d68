"""The positional index against a scan of all windows: nulls, empty and long texts, repeated rows and items, clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import positional_index as index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, row string, key string, spans string"
rng = random.Random(3)
RARE = [f"word{k}é" for k in range(300)]


def prose(n, seed, words=RARE):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


PASSAGE = prose(25, 1)
ITEMS = [
    (1, PASSAGE), (2, prose(30, 2)), (2, prose(30, 2)), (3, "Short-Phrase, here"), (4, None), (5, "?!"), (10, "the of the of the of the of the of the of"), (None, prose(12, 5)), (6, "absent words only"),
    (7, prose(10, 6)), (8, prose(9, 7)),
]
DOCS = [
    (1, prose(40, 11) + " " + PASSAGE.upper() + "; " + prose(40, 12)), (2, None), (3, ""), (4, "x short phrase HERE x Short.phrase\nhere"), (4, "x short phrase HERE x Short.phrase\nhere"),
    (5, PASSAGE[: len(PASSAGE) // 2]), (6, "the of " * 60), (None, prose(12, 5)), (8, prose(9, 6)), (9, prose(10, 6)), (10, prose(9, 7) + " " + prose(9, 7)),
    (11, prose(6000, 13) + " " + prose(30, 2) + " " + prose(6000, 14)), (12, "short"), (13, "phrase here"), (14, "日本語 " * 50), (15, "z" * 20_000 + " " + prose(10, 6)),
]


def phrase_hits(text, items, window):
    """Places inside an occurrence of a window, and the items that occur."""
    w, hit, names, own = words(text), set(), set(), False
    for name, t in items:
        t = words(t)
        n = min(window, len(t))
        for p in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == p:
                    hit |= set(range(i, i + n))
                    names.add(name)
    return w, hit, names


def want(docs, items):
    out = Counter()
    for key, text in docs:
        w, hit, names = phrase_hits(text, items, 10)
        listed = sorted(str(n) for n in names if n is not None)
        out[key, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)] += 1
    return out


def frames(spark):
    docs = spark.createDataFrame([(*d, "r", "k", "s") for d in DOCS], SCHEMA).repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_decontaminate(spark):
    docs, items = frames(spark)
    assert Counter(tuple(r) for r in index.decontaminate(docs, items).drop("spans").collect()) == want(DOCS, ITEMS)
    assert Counter(tuple(r) for r in index.decontaminate(docs, items.filter("false")).drop("spans").collect()) == want(DOCS, [])
    assert index.decontaminate(docs.filter("false"), items).count() == 0


def test_small_segments_and_blocks(spark):
    """Texts in many pieces that overlap, and items in many blocks, give the same; spans are whole."""
    docs, items = frames(spark)
    built = index.build_index(docs, segment=300, overlap=9)
    assert built.count() > 100
    got = index.phrase_matches(built, items, 10, block=100, overlap=9)
    rows = got.select("key", "n_words", index.covered(got.spans), got["items"]).collect()
    assert Counter((r[0], r[1], r[2], tuple(sorted(map(str, r[3])))) for r in rows) == Counter(
        (k, len(w), len(hit), tuple(sorted(str(n) for n in names if n is not None))) for k, t in DOCS for w, hit, names in [phrase_hits(t, ITEMS, 10)]
    )
    with pytest.raises(ValueError):
        index.phrase_matches(built, items, 11, overlap=9)


def near_runs(w, query, span):
    runs = [(i, j) for i in range(len(w)) for j in range(i + 1, min(len(w), i + span) + 1) if query <= set(w[i:j])]
    return {x for x in runs if not any(y != x and y[0] >= x[0] and y[1] <= x[1] for y in runs)}


def test_proximity(spark):
    few = [f"w{k}" for k in range(8)]
    docs = [(k, prose(50, 40 + k, few)) for k in range(6)] + [(20, None), (21, "w1 w2 w3")]
    queries = [(1, "w3 w1 W2"), (2, "w5 w5"), (3, "w0 w9"), (4, ""), (5, "w0 w1 w2 w3 w4 w5 w6")]
    built = index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), segment=90, overlap=6)
    for query in queries:
        got = index.proximity_matches(built, spark.createDataFrame([query], "item_id long, text string"), 6, overlap=6).collect()
        assert len(got) == len(docs)
        for r in got:
            need = set(words(query[1]))
            runs = near_runs(words(dict(docs)[r["key"]]), need, 6) if need else set()
            covered = {p for a, b in runs for p in range(a, b)}
            assert {p for s in r["spans"] for p in range(s["begin"], s["until"])} == covered, (query, r)
            assert r["items"] == ([query[0]] if runs else [])


def test_words_of_one_hash(monkeypatch):
    """If all hashes clash, words are still told apart."""
    monkeypatch.setattr(index, "mixed", lambda x: np.zeros_like(x))
    texts = [index.lowered(b"aa bb aa cc bb aa"), index.lowered(b"dd aa")]
    s = index.Segment(index.make_segment([(0, 0, 0), (1, 1, 0)], texts))
    assert {t: s.places[a : a + n].tolist() for t, a, n in zip(s.terms, s.at, s.counts)} == {b"aa": [0, 2, 5, 7], b"bb": [1, 4], b"cc": [3], b"dd": [6]}
