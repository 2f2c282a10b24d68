"""Hard negatives by distance keys against all pairs: nulls, infinities, ties, repeated rows, unlike lengths, huge components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, pivot string, key string"


def vectors(n, width, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        v = [float(np.float32(x + spread * r.gauss(0, 1))) for x in c]
        out.append((i, v, r.randint(0, 3)))
    return out


def brute(rows, every, positives=5, negatives=10):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            best[i] = min(best.get(i, (label, q)), (label, q))
    def dot(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)

    out = set()
    for a, (label, q) in best.items():
        if a % every == 0:
            scores = sorted((-dot(q, w), i, like) for i, (like, w) in best.items() if i != a)
            for s, p, _ in [x for x in scores if x[2] == label][:positives]:
                fit = [(n, i) for n, i, like in scores if like != label and 30 * -s <= 100 * -n <= 90 * -s]
                out |= {(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, every, **more):
    d = spark.createDataFrame([(*r, "i", "v", "p", "k") for r in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in mining.hard_negatives(d, F.col("vec_id") % every == 0, **more).collect()}


@pytest.mark.parametrize("width,spread", [(3, 0.1), (24, 1.0)])
def test_hard_negatives(spark, width, spread):
    rows = vectors(400, width, width, spread)
    inf, nan = float("inf"), float("nan")
    rows += [(500, None, 1), (501, [1.0] * width, None), (502, [inf] * width, 1), (503, [nan] * width, 1), (504, [None] * width, 1), (None, [1.0] * width, 1), (505, [], 1), (510, [0.5], 2)]
    rows += [(600 + k, rows[7][1], k % 2) for k in range(30)]  # ties
    rows += [rows[20], rows[20], (20, rows[21][1], 9)]  # repeated rows, and another of the same id
    got = mined(spark, rows, 10)
    assert got and got == brute(rows, 10)


def test_groups_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(mining, "GROUP_BYTES", 500)
    rows = vectors(150, 6, 1, 0.3)
    assert mined(spark, rows, 15, pivots=3) == brute(rows, 15)


def test_clusters_are_pruned(spark):
    """Where vectors have clusters, the first scans read only keys near the anchors'."""
    rows = spark.createDataFrame([(i, [*map(float, np.eye(8)[i % 8] * 50), i % 97 / 97], i % 2) for i in range(4000)], "id long, vector array<double>, label long")
    rows = rows.select("id", "label", mining.quantised(F.col("vector")).alias("vector"))
    space, *_ = mining.fit_space(rows)
    index = mining.build_index(rows, space)
    q = np.array([index.orderBy("pivot", "key").first()["vector"]])
    own = (q**2).sum(1)
    near = mining.Search(
        np.array([0]), np.array([0]), q, space.anchor_keys(q), np.array([-1.0]), space.radius(own, own) + space.slack + 5000, np.array([0]), np.array([-(2**63)]), np.array([2**63 - 1]), np.array([-(2**63)]), np.zeros((1, 3), "int64"), True, 5,
    )
    scan = mining._scan(index, near, space)
    assert "PushedFilters: [Or(" in scan._jdf.queryExecution().toString()
    assert scan.count() >= 5


def test_huge_components_and_few_rows(spark):
    rows = [(0, [1e30, 1e30], 1), (1, [1e30, 1.0], 1), (2, [1e29, 3.0], 2), (3, [2e29, 1e29], 2), (4, [-1e30, 0.0], 2)]
    assert mined(spark, rows, 2) == brute(rows, 2)
    big = [(i, [float(3e4 * (i + 1)), float(1e4 * (9 - i))], i % 2) for i in range(9)]
    assert mined(spark, big, 2) == brute(big, 2)
    assert mined(spark, rows[:1], 1) == set()
    assert mined(spark, [], 1) == set()
