"""The Merkle manifest against a recursive one on edge cases: null groups and fields, repeated rows, lone nodes, no rows."""

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, idx string, digest string, run string"


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tampered(row):
    return row[1].replace("\n", "") if row[1] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[1]


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        at = i - i % 3
        out.append(("".join(level[at:i]), "".join(level[i + 1 : at + 3])))
        i //= 3
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, tampered(r))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for i, (known, key, own, changed) in enumerate(sorted(by[s])):
            proof = steps(trees[s], i) + steps(top, k)
            folded = changed
            for left, right in proof:
                folded = digest(left + folded + right)
            root = top[-1][0]
            out[key if known else None, own, trees[s][-1][0], root, digest("".join(a + b for a, b in proof)), folded, folded == root] += 1
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "g", "i", "d", "r") for r in rows], SCHEMA).repartition(3)
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return Counter(tuple(r) for r in merkle.verify(merkle.manifest(docs, check={"text": text})).collect())


def test_merkle_manifest(spark):
    sizes = {"a": 1, "b": 2, "ä": 3, "Z": 4, "c": 28, None: 10, "": 5}
    rows = [(1000 * k + i, f"line {i}\nnext é {s}", "en", s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(7, None, None, "c", None), (7, "", "", "c", 0), (8, "same\n", "en", "c", 5), (8, "same\n", "en", "c", 5), (None, "no\nid", None, "c", None), (9, "\n" * 50_000, "x", "c", 50_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_trees(spark):
    """A lone row is its own root, with an empty proof; one group's root is the root; no rows give no rows."""
    one = [(1, "a\nb", "en", "s", 3)]
    assert run(spark, one) == brute(one)
    group = [(i, f"t{i}", None, None, 1) for i in range(4)]
    assert run(spark, group) == brute(group)
    assert not run(spark, [])
