"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's sketch is the smallest hashes of its shingle set. Inverted lists of retained values give the overlaps of
pairs; those whose set sizes allow the similarity are verified on the full sets, likeliest first: the bottom-k sketch of
a pair's union, known from the ranks of the shared values, estimates it. Documents with equal sets are one node.

Values that more than LIST nodes retain are set apart, so that all pairs of the other lists are few. A pair with
similarity 0.8 shares each of the union's smallest values with probability 0.8. As long as at most 60 % of a sketch are
such frequent values, at least half of the union's other values are shared, and that none of 24 is has probability
6e-8. Documents made of frequent values (members of large groups, or of little but a common passage) also meet in the
lists of their frequent values: first with the most central member of each list; then members outside a list's largest
component meet all members of other components, in blocks, on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.rolling import shingle_sets
from graphloom.llm.text import join_decisions, or_empty
from graphloom.runtime import broadcast_if_few, join_split, prepare_python, stage

SKETCH = 64
#: Values of a sketch that are not frequent and enter lists, and frequent ones that do where those are too few.
RETAINED, FREQUENT = 24, 16
#: Nodes that may share a value before it counts as frequent.
LIST = 32
#: Members of a block of a frequent list, and bytes of their texts.
BLOCK, BLOCK_BYTES = 512, 4 << 20


def sketches(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row id, _hash, n (set size), sig (digest of the set) and sketch (ascending longs)."""
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("id"), F.xxhash64(or_empty(text)).alias("_hash"), or_empty(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("_hash"), pa.array([len(s) for s in sets], "int64"),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "binary"),
                pa.array([s[:SKETCH].view("int64") for s in sets], pa.list_(pa.int64())),
            ], ["id", "_hash", "n", "sig", "sketch"])

    return d.mapInArrow(sketch, f"id {kind}, _hash long, n long, sig binary, sketch array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int, most: int) -> DataFrame:
    """The pairs (a, b), ``most`` at most, whose full sets have 100 * intersection >= percent * union. ``texts``: (rid, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            sets = [shingle_sets([t.encode() for t in batch.column(c).to_pylist()], words) for c in ("ta", "tb")]
            good = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, "bool"))

    left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    return stage(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links", most)


def _ordinary_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b, est) from lists of at most LIST nodes, with the union-sketch estimate. lists: v, rid, n, rank, held.

    Only pairs are left out whose sizes rule a link out: the intersection is the smaller set at most, the union the larger
    one at least. The estimate drops none, as it says little of pairs that share their frequent values.
    """
    x, y = lists.alias("x"), lists.alias("y")
    possible = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    met = x.join(y, "v").filter("x.rid < y.rid").filter(possible)
    met = met.groupBy(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x.rank").alias("p"), F.col("y.rank").alias("q")))).alias("met"),
        F.least(F.first("x.held"), F.first("y.held")).alias("k"),
    )
    # The i-th shared value (from 0) has rank p + q - i - 1 in the union; the union's sketch has k values.
    inside = F.size(F.filter("met", lambda m, i: m["p"] + m["q"] - i - 1 <= F.col("k")))
    return met.select("a", "b", (inside / F.col("k")).alias("est"))


def _block_links(odd: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of each list's ``odd`` members with its ``members`` of other components (v, rid, label, text).

    Blocks meet blocks, and full sets are compared within a task, so that only links leave it: for each odd member and
    each component that it is linked with, one.
    """
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    blocks = members.groupBy("v").agg(F.ceil(size).cast("int").alias("blocks"))
    held = F.collect_list(F.struct("rid", "label", "text"))

    def packed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.join(blocks, "v").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
        return rows.groupBy("v", "block").agg(held.alias(name)).withColumnRenamed("block", f"{name}_block")

    def side(rows: list[dict]):
        sets = shingle_sets([r["text"].encode() for r in rows], words)
        return np.array([r["rid"] for r in rows]), np.array([r["label"] for r in rows]), sets

    def incidence(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(common)), "float32")
        for i, s in enumerate(sets):
            at = np.searchsorted(common, s)
            at = at[at < len(common)]
            out[i, at[np.isin(common[at], s, assume_unique=False)]] = 1
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for lo in range(batch.num_rows) for r in batch.slice(lo, 1).to_pylist()):
            (ra, la, sa), (rb, lb, sb) = side(row["a"]), side(row["b"])
            common = np.intersect1d(np.concatenate(sa), np.concatenate(sb))
            both = incidence(sa, common) @ incidence(sb, common).T
            either = np.add.outer([len(x) for x in sa], [len(x) for x in sb]) - both
            i, j = np.nonzero((100 * both >= percent * either) & (la[:, None] != lb[None, :]))
            pick = np.unique(np.stack([i, lb[j]]), axis=1, return_index=True)[1]
            x, y = ra[i[pick]], rb[j[pick]]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    met = packed(odd, "a").join(packed(members, "b"), "v").repartition("v", "a_block", "b_block")
    return met.select("a", "b").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``key``, n_shingles, component_id, kept, ``_hash`` of the text, ``_label`` of the component.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; component_id is the smallest
    id reachable. Texts without words, empty or null, have no shingles and are linked with nothing. Repeated rows are
    one document. Null ids join components but never name one, unless all ids of it are null. A text of any length is
    hashed whole, in one task with some tens of times its size. An empty table gives no rows. Other columns of ``docs`` are
    not read.
    """
    prepare_python(docs.sparkSession)
    rows = stage(sketches(docs, words, key, text), "sketches")
    total = rows.count()
    some = rows.filter("n > 0")
    nodes = some.groupBy("sig").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
        F.min(F.struct("id", "_hash")).alias("one"),
    )
    nodes = stage(nodes.withColumn("rid", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()

    lists = nodes.select("rid", F.posexplode("sketch").alias("pos", "v"))
    shared = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = broadcast_if_few(stage(shared, "values", SKETCH * count))
    # Only shared values matter further on, but ranks count all values that aren't frequent.
    postings = stage(lists.join(shared, "v"), "postings", SKETCH * count)
    frequent = F.col("c") > LIST
    of_node = Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = postings.withColumn("before", F.sum(F.when(frequent, 1).otherwise(0)).over(of_node))
    ranked = ranked.join(nodes.select("rid", "n", F.size("sketch").alias("size")), "rid")
    ranked = ranked.withColumn("often", F.sum(F.when(frequent, 1).otherwise(0)).over(Window.partitionBy("rid")))
    ranked = ranked.withColumn("rank", F.when(frequent, F.col("before")).otherwise(F.col("pos") + 1 - F.col("before")))
    ranked = ranked.withColumn("held", F.least(F.col("size") - F.col("often"), F.lit(RETAINED)))
    ranked = stage(ranked.select("v", "c", "rid", "n", "rank", "held", "often", frequent.alias("frequent")), "ranked", SKETCH * count)

    ordinary = ranked.filter(~F.col("frequent") & (F.col("rank") <= RETAINED)).select("v", "rid", "n", "rank", "held")
    pairs = _ordinary_pairs(ordinary, percent)
    # Documents of mostly frequent values, in the lists of their first frequent ones; central: most frequent values.
    common = ranked.filter("frequent").filter((F.col("held") < RETAINED) & (F.col("rank") <= FREQUENT)).select("v", "rid", "often")
    centre = common.groupBy("v").agg(F.max(F.struct("often", (-F.col("rid")).alias("r"))).alias("top"))
    stars = common.join(centre.select("v", (-F.col("top.r")).alias("centre")), "v").filter("rid <> centre")
    stars = stars.select(F.least("rid", "centre").alias("a"), F.greatest("rid", "centre").alias("b"), F.lit(1.0).alias("est"))
    pairs = stage(pairs.unionByName(stars.distinct()), "pairs", RETAINED * count)

    involved = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).union(common.select("rid")).distinct()
    wanted = nodes.join(involved, "rid", "left_semi").select("rid", F.col("one.id").alias("_id"), F.col("one._hash").alias("_hash"))
    texts = join_decisions(docs, stage(wanted, "wanted", count), "inner", key, text)
    # Rows repeated with one id and text would repeat their links.
    texts = stage(texts.select("x.rid", F.coalesce(F.col(f"d.`{text}`"), F.lit("")).alias("text")), "texts")
    texts = texts if texts.count() == texts.select("rid").distinct().count() else stage(texts.groupBy("rid").agg(F.first("text").alias("text")), "texts")

    # First each node's likeliest link, then whatever is left between components.
    best = Window.partitionBy("b").orderBy(F.desc("est"), "a")
    first = pairs.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("a", "b")
    links = verify(stage(first, "first", count), texts, words, percent, count)
    rest = _across(pairs.select("a", "b").exceptAll(first).distinct(), components(links, count))
    links = links.unionByName(verify(stage(rest, "rest", RETAINED * count), texts, words, percent, RETAINED * count))
    labels = components(links, count)
    if not common.isEmpty():
        seen = common.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        largest = seen.groupBy("v", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(F.max(F.struct("k", "label")).alias("top"))
        odd = stage(seen.join(largest, "v").filter("label <> top.label").select("v", "rid", "label"), "odd", FREQUENT * count)
        if not odd.isEmpty():
            with_text = lambda x: x.select("v", "rid", "label").join(texts, "rid")
            members = with_text(seen.join(odd.select("v").distinct(), "v", "left_semi"))
            links = links.unionByName(stage(_block_links(with_text(odd), members, words, percent), "more", FREQUENT * count))
            labels = components(links, count)

    named = nodes.select("rid", "sig", "least", "rows").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = stage(named.join(smallest, "label").select("sig", "rows", "component_id", F.col("label").alias("_label")), "named", count)
    linked = join_split(some.select("id", "_hash", "n", "sig"), named, "sig", "rows", total).select("id", "_hash", "n", "component_id", "_label")
    alone = rows.filter("n = 0").select("id", "_hash", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("_label"))
    out = linked.unionByName(alone)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "_hash", "_label")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    la, lb = (labels.select(F.col("rid").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    joined = pairs.join(la, "a", "left").join(lb, "b", "left")
    return joined.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, in their own columns: that of the smallest id.

    Of rows that share this id and its text, or of a component of null ids only, one stays, whichever. Null and empty texts
    and texts without words are linked with nothing and all stay, repeated ones too. An empty table stays empty.
    """
    marked = stage(near_duplicates(docs, key, text, words, percent).withColumnRenamed(key, "_id"), "marked")
    kept = marked.filter(F.col("kept") & (F.col("n_shingles") > 0))
    # Rows repeated with id and text, or without an id, may leave a component several: those are thinned out.
    many = kept.groupBy("_label").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("_id", "_hash")).alias("one")).filter("rows > 1")
    many = stage(many.select("_label", "one"), "several")
    gone = marked.filter(~F.col("kept")).select("_id", "_hash")
    others = kept.join(many, "_label").filter(~(F.col("_id").eqNullSafe(F.col("one._id")) & (F.col("_hash") == F.col("one._hash"))))
    rest = join_decisions(docs, gone.unionByName(others.select("_id", "_hash")).distinct(), "left_anti", key, text).select("d.*")
    if many.isEmpty():
        return rest
    ones = many.select("one._id", "one._hash")
    thinned = join_decisions(rest, ones, "left_semi", key, text).select("d.*").dropDuplicates([key, text])
    return join_decisions(rest, ones, "left_anti", key, text).select("d.*").unionByName(thinned)
