"""Hard-negative mining by one-dimensional distance keys.

Inner products are turned into distances: every vector gets one more component that makes all norms equal, so that the
largest products with an anchor belong to its nearest neighbours. Each vector is stored under (pivot, distance to it), the
pivot being the nearest of some centres, in a table sorted by that key. An anchor's search scans, around each pivot, the
keys within a radius of the anchor's own distance to it: by the triangle inequality all others are farther than the
radius. The radius grows, and each round scans only the keys, and so the annuli, that are new, until no row outside can
score as much as the last of the first k. Searches are therefore exact whatever the pivots are; those are fitted on a sample.

Anchors are searched for in groups of bounded size, each sent to all tasks of a scan; scans read only their keys' ranges.
Tasks give a first k of their own, merged by a shuffle; of a group only bounds come back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.runtime import numbered, prepare_python, scratch_path, stage

#: Pivots, and rows of the sample that they and first radii are fitted on; also at most SAMPLE_BYTES.
PIVOTS, SAMPLE, SAMPLE_BYTES = 16, 2048, 16 << 20
#: Bytes of the vectors of a group of anchors, and rows and anchors whose products are held at once.
GROUP_BYTES, ROWS, ANCHORS = 8 << 20, 2048, 256


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Each component times ``scale``, rounded down, as a double; null where the vector or a component is null or not finite."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & finite, F.transform(vector, whole))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; those of fewer components end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(x: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    """Integer inner products of rows of two matrices of whole numbers, at the ends of a long where they are beyond it."""
    if norm * norm < 2.0**53:  # sums of doubles are exact as far as that
        return (x @ q.T).astype("int64")
    whole = np.vectorize(int, otypes=[object])
    out = [[min(max(sum(a * b for a, b in zip(r, s)), -(2**63)), 2**63 - 1) for s in whole(q)] for r in whole(x)]
    return np.array(out, "int64").reshape(len(x), len(q))


@dataclass
class Space:
    """Pivots with one more component than vectors, the largest norm, and the slack for rounding in distances."""

    pivots: np.ndarray
    norm: float
    width: int

    @property
    def slack(self) -> float:
        return 1e-5 * (self.norm + 1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Distances of stored vectors, whose last component fills them up to the norm, to all pivots."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return self._distances(np.column_stack([x, rest]))

    def anchor_keys(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors, whose last component is zero, to all pivots."""
        return self._distances(np.column_stack([q, np.zeros(len(q))]))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        square = (x**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def radius(self, own: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from an anchor of squared norm ``own`` at which rows have this score."""
        return np.sqrt(np.maximum(own + self.norm**2 - 2 * score, 0))

    def best_beyond(self, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A bound of the scores of all rows that are farther than the radius."""
        return (own + self.norm**2 - np.maximum(radius - self.slack, 0) ** 2) / 2


def fit_space(rows: DataFrame, pivots: int = PIVOTS) -> tuple[Space, np.ndarray, np.ndarray]:
    """Pivots by some rounds of k-means over a sample of rows by a hash of their ids; also the sample's vectors and labels."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.max(square).alias("square"), F.max(F.size("vector")).alias("width")).first()
    norm, width = float(np.sqrt(stats["square"] or 0.0)), int(stats["width"] or 0)
    most = max(pivots, min(SAMPLE, SAMPLE_BYTES // (8 * width + 64)))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("vector", "label").collect()
    sample = np.zeros((len(got), width))
    for k, r in enumerate(got):
        sample[k, : len(r["vector"])] = r["vector"]
    filled = np.column_stack([sample, np.sqrt(np.maximum(norm**2 - (sample**2).sum(1), 0))])
    centres = filled[np.linspace(0, len(filled) - 1, min(pivots, len(filled))).astype(int)] if len(filled) else np.zeros((1, width + 1))
    for _ in range(8 if len(filled) else 0):
        near = ((filled[:, None, :16] - centres[None, :, :16]) ** 2).sum(2).argmin(1) if width < 16 else (-2 * filled @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.array([filled[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return Space(centres, norm, width), sample, np.array([r["label"] for r in got], "int64")


def build_index(rows: DataFrame, space: Space) -> DataFrame:
    """Rows (id, label, vector) with pivot and key, written sorted by these."""
    prepare_python(rows.sparkSession)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.keys(_matrix(b.column(2), space.width))
            near = d.argmin(1) if len(d) else np.zeros(0, "int64")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near.astype("int32")), pa.array(d[np.arange(len(d)), near])], ["id", "label", "vector", "pivot", "key"]
            )

    keyed = rows.select("id", "label", "vector").mapInArrow(place, "id long, label long, vector array<double>, pivot int, key double")
    path = scratch_path(rows.sparkSession, "distance_keys")
    keyed.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id").write.parquet(path)
    return rows.sparkSession.read.schema(keyed.schema).parquet(path)


@dataclass
class Search:
    """A group's anchors, and their slots: windows of scores of which the first ``k`` rows are wanted, slots in order of anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    keys: np.ndarray  # distances to the pivots
    done: np.ndarray  # radius scanned so far; negative: none
    radius: np.ndarray
    owner: np.ndarray  # a slot's anchor
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray  # the least score that can still enter
    tag: np.ndarray  # the positive's id and score, and the slot's number in the whole group
    same: bool
    k: int

    @property
    def own(self) -> np.ndarray:
        return (self.vectors**2).sum(1)

    def of(self, anchors: np.ndarray) -> Search:
        """The search of some anchors only."""
        number = np.full(len(self.ids), -1)
        number[anchors] = np.arange(len(anchors))
        slots = number[self.owner] >= 0
        by_anchor = {c: getattr(self, c)[anchors] for c in ("ids", "labels", "vectors", "keys", "done", "radius")}
        return replace(self, **by_anchor, owner=number[self.owner[slots]], **{c: getattr(self, c)[slots] for c in ("low", "high", "bound", "tag")})


def _scan(index: DataFrame, search: Search, space: Space) -> DataFrame:
    """Each task's first k rows of every slot, from keys within the radius and beyond what was done."""
    spark = index.sparkSession
    reach = None
    for p in range(len(space.pivots)):
        low, high = (search.keys[:, p] - search.radius).min(), (search.keys[:, p] + search.radius).max()
        part = (F.col("pivot") == p) & (F.col("key") >= float(low)) & (F.col("key") <= float(high))
        reach = part if reach is None else reach | part
    sent = spark.sparkContext.broadcast((search, space))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, space = sent.value
        bound = search.bound.copy()
        inner = np.full(len(search.ids), np.inf)
        np.minimum.at(inner, search.owner, space.radius(search.own[search.owner], search.high.astype("float64")) - space.slack)
        least, most = np.full(len(search.ids), np.inf), np.full(len(search.ids), -np.inf)
        np.maximum.at(most, search.owner, search.high.astype("float64"))
        first_slot = np.searchsorted(search.owner, np.arange(len(search.ids) + 1))
        np.minimum.at(least, search.owner, np.maximum(bound, search.low).astype("float64"))
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, labels, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), space.width)
                pivot, key = part.column(3).to_numpy(), part.column(4).to_numpy()
                meets = np.zeros(len(search.ids), bool)
                for p in np.unique(pivot):
                    lo, hi = key[pivot == p].min(), key[pivot == p].max()
                    mine = search.keys[:, p]
                    far = np.maximum(np.abs(lo - mine), np.abs(hi - mine))
                    meets |= (mine - search.radius <= hi) & (mine + search.radius >= lo) & (far > search.done) & (mine + hi >= inner)
                active = np.flatnonzero(meets)
                for c in range(0, len(active), ANCHORS):
                    some = active[c : c + ANCHORS]
                    score = products(x, search.vectors[some], space.norm)
                    gap = np.abs(key[:, None] - search.keys[some][:, pivot].T)
                    like = labels[:, None] == search.labels[some]
                    fits = (gap <= search.radius[some]) & (gap > search.done[some]) & (like == search.same)
                    fits &= (ids[:, None] != search.ids[some]) & (score >= least[some]) & (score <= most[some])
                    who, row = np.nonzero(fits.T)
                    edges = np.searchsorted(who, np.arange(len(some) + 1))
                    for k in np.flatnonzero(np.diff(edges)):
                        a, r = int(some[k]), row[edges[k] : edges[k + 1]]
                        s, i = score[r, k], ids[r]
                        for slot in range(first_slot[a], first_slot[a + 1]):
                            take = (s >= max(bound[slot], search.low[slot])) & (s <= search.high[slot])
                            if take.any():
                                old = kept.get(slot, (s[:0], i[:0]))
                                both, names = np.concatenate([old[0], s[take]]), np.concatenate([old[1], i[take]])
                                order = np.lexsort((names, -both))[: search.k]
                                kept[slot] = both[order], names[order]
                                if len(order) == search.k:
                                    bound[slot] = max(bound[slot], both[order[-1]])
                        slots = slice(first_slot[a], first_slot[a + 1])
                        least[a] = np.maximum(bound[slots], search.low[slots]).min()
        size = [len(v[0]) for v in kept.values()]
        slots = np.repeat(np.fromiter(kept, "int64", len(kept)), size)
        score, names = (np.concatenate([v[k] for v in kept.values()] or [np.zeros(0, "int64")]) for k in (0, 1))
        columns = [search.ids[search.owner[slots]], *search.tag[slots].T, names, score]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype("int64")) for c in columns], ["anchor_id", "positive_id", "positive_score", "slot", "found_id", "score"])

    return index.filter(reach).mapInArrow(scan, "anchor_id long, positive_id long, positive_score long, slot long, found_id long, score long")


def run_search(index: DataFrame, search: Search, space: Space) -> DataFrame:
    """The first k rows of every slot, ranked: scans of growing radius until each slot is certain."""
    first = Window.partitionBy("slot").orderBy(F.desc("score"), "found_id")
    own, whole = search.own, 4 * space.norm + 4 * space.slack  # farther than any two points
    open_ = np.arange(len(search.ids))
    found = None
    while True:
        part = _scan(index, search.of(open_), space)
        part = part if found is None else part.unionByName(found.drop("rank"))
        found = stage(part.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= search.k), "hard_negatives")
        got = found.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).collect()
        for r in got:
            if r["n"] == search.k:
                search.bound[r["slot"]] = max(search.bound[r["slot"]], r["last"])
        full = np.zeros(len(search.owner), bool)
        full[[r["slot"] for r in got if r["n"] == search.k]] = True
        # A slot is certain if no row beyond the radius can enter it any more.
        wanted = np.where(full, search.bound, search.low).astype("float64")
        beyond = space.best_beyond(own, search.radius)[search.owner]
        certain = (beyond < wanted) | (search.radius[search.owner] >= whole)
        search.done = search.radius.copy()
        open_ = np.unique(search.owner[~certain])
        if not len(open_):
            return found
        # A full slot needs the distance of its last row; the others look twice as far, up to the end of their window.
        need = space.radius(own[search.owner], wanted) + 2 * space.slack
        need = np.where(full, need, np.minimum(need, 2 * search.radius[search.owner] + space.slack))
        radius = search.radius.copy()
        np.maximum.at(radius, search.owner[~certain], need[~certain])
        search.radius = np.minimum(radius, whole)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor (``is_anchor`` over key) the first ``positives`` other rows of its label, by inner product of quantised
    vectors and then id; for each of these the first ``negatives`` rows of other labels whose score is ``low`` to ``high``
    percent of the positive's. Positives with a negative score have none. Rows with a null id, label, vector or component, or
    one that isn't finite, take no part. Rows of one id are one row, that of the smallest label and vector. Shorter vectors end
    in zeros. Scores beyond a long are its ends. An empty table gives no rows. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    slim = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"), quantised(F.col(f"`{vector}`")).alias("vector"),
    ).dropna()
    rows = stage(slim.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_")).select("id", "_.label", "_.vector"), "vectors")
    space, sample, sample_labels = fit_space(rows, pivots)
    index = build_index(rows, space)
    anchors = numbered(index.withColumnRenamed("id", key).filter(is_anchor).withColumnRenamed(key, "id"), [F.col("pivot"), F.col("key"), F.col("id")], "place")
    count, size = anchors.count(), max(1, min(1 << 16, GROUP_BYTES // (8 * space.width + 8)))
    out = scratch_path(spark, "mined")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for lo in range(0, count, size):
        group = anchors.filter((F.col("place") >= lo) & (F.col("place") < lo + size)).orderBy("place").collect()
        q = np.zeros((len(group), space.width))
        for k, r in enumerate(group):
            q[k, : len(r["vector"])] = r["vector"]
        n, least, most = len(group), -(2**63), 2**63 - 1
        ids, labels = (np.array([r[c] for r in group], "int64") for c in ("id", "label"))
        own = (q**2).sum(1)
        like = np.where(labels[:, None] == sample_labels, q @ sample.T, -np.inf)
        like[like >= own[:, None]] = -np.inf  # the anchor itself may be in the sample
        guess = like.max(1, initial=-np.inf)
        guess = np.where(np.isfinite(guess), guess, 0)
        search = Search(
            ids, labels, q, space.anchor_keys(q), np.full(n, -1.0), space.radius(own, guess) + space.slack, np.arange(n),
            np.full(n, least), np.full(n, most), np.full(n, least), np.column_stack([np.zeros((n, 2), "int64"), np.arange(n)]), True, positives,
        )
        number = {int(i): k for k, i in enumerate(ids)}
        best = [(number[r["anchor_id"]], r["found_id"], r["score"]) for r in run_search(index, search, space).select("anchor_id", "found_id", "score").collect()]
        best = sorted(x for x in best if x[2] >= 0)  # at most ``positives`` an anchor
        if not best:
            continue
        owner, names, score = (np.array(x, "int64") for x in zip(*best))
        floor = [-(-low * int(s) // 100) for s in score]
        ceil = [high * int(s) // 100 for s in score]
        mine = np.unique(owner)
        nearest = np.full(n, -1.0)
        np.maximum.at(nearest, owner, space.radius(own[owner], np.array(ceil, "float64")))
        search = Search(
            ids, labels, q, space.anchor_keys(q), np.full(n, -1.0), 1.02 * nearest + space.slack, owner,
            np.array(floor, "int64"), np.array(ceil, "int64"), np.full(len(owner), least), np.column_stack([names, score, np.arange(len(owner))]), False, negatives,
        ).of(mine)
        mined = run_search(index, search, space)
        mined.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
