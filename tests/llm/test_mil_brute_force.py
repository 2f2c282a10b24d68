"""The classifier's scores against plain loops over passages, features and gates; documents whose score is exactly one half."""

import math
import random

import numpy as np
import pytest

from graphloom.llm import mil_classifier as mil

MASK = 0xFFFFFFFF


def features(passage):
    """Square roots of hashed trigram counts, shares of byte classes, and the variety of trigrams."""
    grams = [0] * mil.CELLS
    for a, b, c in zip(passage, passage[1:], passage[2:]):
        mixed = (a * 0x9E3779B1 & MASK) ^ (b * 0x85EBCA77 & MASK) ^ (c * 0xC2B2AE3D & MASK)
        grams[(mixed * 0x27D4EB2F & MASK) >> 22] += 1
    classes = [0] * 6
    for b in passage:
        classes[0 if b < 33 else 1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123 else 4 if b >= 128 else 5] += 1
    total, size = sum(grams), max(len(passage), 1)
    scale = 4 / max(math.sqrt(total), 1)
    return [math.sqrt(n) * scale for n in grams] + [3 * n / size for n in classes] + [3 * sum(n > 0 for n in grams) / max(total, 1)]


def score(text, p):
    """One document: encode every passage, weigh it by its gate, score the weighted sum."""
    bag = [text[i : i + mil.PASSAGE] for i in range(0, max(len(text), 1), mil.PASSAGE)]
    hidden, logits = [], []
    for passage in bag:
        x = features(passage)
        h = [math.tanh(sum(v * p["W"][k][j] for k, v in enumerate(x) if v) + p["b"][j]) for j in range(mil.WIDTH)]
        gate = 0.0
        for j in range(mil.GATE):
            t = math.tanh(sum(h[k] * p["V"][k][j] for k in range(mil.WIDTH)))
            g = 1 / (1 + math.exp(-sum(h[k] * p["U"][k][j] for k in range(mil.WIDTH))))
            gate += t * g * p["w"][j][0]
        hidden.append(h)
        logits.append(gate)
    top = max(logits)
    mass = sum(math.exp(s - top) for s in logits)
    out = p["d"][0]
    for h, s in zip(hidden, logits):
        out += math.exp(s - top) / mass * sum(h[k] * p["c"][k][0] for k in range(mil.WIDTH))
    return 1 / (1 + math.exp(-min(max(out, -30), 30)))


TEXTS = [None, "", "a", "ab", "short text, 12 WORDS é", "日本語" * 200, "x" * 512, "y" * 513, " \n\t" * 400, "Mixed Case 123! " * 130]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("abcdef ABC,.019\n") for _ in range(r.randint(1, 3000))) for _ in range(20)]
    return texts, spark.createDataFrame([(i, t, "s", "p") for i, t in enumerate(texts)], "doc_id long, text string, score string, predicted string").repartition(3)


@pytest.mark.parametrize("fitted", [False, True])
def test_scores(docs, fitted):
    texts, df = docs
    model = mil.Attention(3)
    if fitted:
        model.fit([(t or "").encode() for t in texts], np.array([i % 2 for i in range(len(texts))]), epochs=3)
    p = {k: v.astype("float64").tolist() for k, v in model.p.items()}
    got = {r.doc_id: r for r in mil.classify(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(score((t or "").encode(), p), abs=2e-5)
        assert got[i].predicted == (got[i].score >= 0.5)
    assert len({round(r.score, 6) for r in got.values()}) > 10


def test_even_score_counts_as_good(docs):
    model = mil.Attention()
    model.p["c"][:] = 0
    assert {(r.score, r.predicted) for r in mil.classify(docs[1], model).collect()} == {(0.5, 1)}
