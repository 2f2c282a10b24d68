"""A Merkle manifest of a dataset: digests of rows, trees by group, one root, and a proof for every row.

Levels are made by windows: partitioned by group and parent, an ordered ``collect_list`` over the full frame gives every
node its run, which is both the preimage of the parent and, without the node itself, its siblings. One node of each run
then stands for the parent on the next level, so levels shrink by the arity. Proofs are handed down from the root, each
node's siblings before its parent's, in joins whose sizes shrink alike. No group meets in one task: places within a group
come from a range partitioning, and all keys are (group, parent), of which no more than one run is equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import join_split, numbered, stage

#: Children of a node.
ARITY = 3


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row's fields in order, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def build(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees, leaves first, and the groups' roots.

    ``nodes`` has g, idx (gapless from 0 in g), n (nodes of g) and digest; other columns stay on the first level. Each level
    has g, idx, n, digest and run (the digests under the node's parent; null for a root). Roots: g, root.
    """
    parent = F.floor(F.col("idx") / arity).cast("long")
    run = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels, left = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        whole = F.when(F.col("n") > 1, F.collect_list("digest").over(run))
        level = stage(nodes.withColumn("parent", parent).withColumn("run", whole).drop("parent"), "merkle_level")
        levels.append(level)
        if left <= 1:
            break
        left = -(-left // arity)
        # The run's first node stands for its parent: the others are the parent's duplicates.
        first = level.filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
        preimage = F.array_join(F.transform("run", as_hex), "")
        nodes = first.select("g", parent.alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"), F.unhex(F.sha2(preimage, 256)).alias("digest"))
    roots = [x.filter("n = 1").select("g", F.col("digest").alias("root")) for x in levels]
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, stage(out, "merkle_roots")


def hand_down(levels: list[DataFrame], roots: DataFrame, arity: int = ARITY) -> DataFrame:
    """The first level with the columns of ``roots`` and each node's proof: ``siblings``, their bytes from its own run up
    to the root's, and ``shape``, two digits a level that count siblings to the left and right.

    ``roots`` has one row a group, with the siblings and shape that a group's root already has.
    """
    carried = [c for c in roots.columns if c not in ("g", "siblings", "shape")]
    at = (F.col("idx") % arity).cast("int")
    out = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k].alias("c")
        keep = [F.col(f"c.{c}") for c in levels[k].columns if c not in ("run", "n")]
        top = level.filter("c.n = 1").join(roots.alias("r"), "g").select(*keep, *[F.col(f"r.{c}") for c in (*carried, "siblings", "shape")])
        if out is None:
            out = top
        else:
            up = out.select("g", F.col("idx").alias("parent"), *carried, "siblings", "shape").alias("p")
            below = level.filter("c.n > 1").withColumn("parent", F.floor(F.col("idx") / arity).cast("long")).alias("c")
            others = F.array_join(F.transform(F.filter("c.run", lambda x, i: i != at), F.hex), "")
            shape = F.concat(at.cast("string"), (F.size("c.run") - 1 - at).cast("string"))
            joined = below.join(up, ["g", "parent"])
            out = joined.select(
                *keep, *[F.col(f"p.{c}") for c in carried],
                F.concat(F.unhex(others), F.col("p.siblings")).alias("siblings"), F.concat(shape, F.col("p.shape")).alias("shape"),
            ).unionByName(top)
        if k:
            out = stage(out, "merkle_proofs")
    return out


def fold(leaf: Column, siblings: Column, shape: Column) -> Column:
    """The root that a leaf's digest and a proof give, in hex: digests of runs, level by level."""
    start = F.struct(as_hex(leaf).alias("digest"), F.lit(0).alias("used"))

    def up(acc: Column, k: Column) -> Column:
        left, right = (F.substring(shape, 2 * k + i, F.lit(1)).cast("int") for i in (1, 2))

        def part(first: Column, count: Column) -> Column:
            return as_hex(F.substring(siblings, 32 * first + 1, 32 * count))

        text = F.concat(part(acc["used"], left), acc["digest"], part(acc["used"] + left, right))
        return F.struct(F.sha2(text, 256).alias("digest"), (acc["used"] + left + right).alias("used"))

    levels = F.slice(F.sequence(F.lit(0), F.length(shape)), F.lit(1), (F.length(shape) / 2).cast("int"))
    return F.aggregate(levels, start, up, lambda acc: acc["digest"])


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    check: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``key``, leaf, subroot, root, siblings (bytes), shape, and ``checked``, the digest of the row
    with the columns of ``check`` in place of its own (the leaf where there are none). Digests are 32 bytes.

    Leaves of a group ascend by ``key`` (null first), rows of one key by their digest; repeated rows are leaves each. Null
    is a group of its own, the first; any field may be null, empty or long, and texts are read once and never shuffled.
    An empty table gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    changed = [(check or {}).get(c, F.col(f"`{c}`")) for c in fields]
    digests = docs.select(
        F.col(f"`{key}`").alias("id"), F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")).alias("g"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"), leaf_digest(changed).alias("checked"),
    )
    placed = numbered(stage(digests, "merkle_leaves"), [F.col("g"), F.col("id"), F.col("digest"), F.col("checked")], "place")
    groups = stage(placed.groupBy("g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "merkle_groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    nodes = join_split(placed, groups, "g", "n", total).withColumn("idx", F.col("place") - F.col("first")).drop("place", "first")
    levels, subroots = build(nodes)

    count = subroots.count()
    tops = numbered(subroots, [F.col("g")], "idx").select(F.lit("").alias("g"), "idx", F.lit(count).cast("long").alias("n"), F.col("root").alias("digest"), F.col("g").alias("group"))
    above, root = build(tops)
    start = root.select("g", "root", F.lit(b"").alias("siblings"), F.lit("").alias("shape"))
    roots = hand_down(above, start).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", "siblings", "shape")
    out = hand_down(levels, stage(roots, "merkle_tops"))
    return out.select(F.col("id").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "siblings", "shape", "checked")


def verify(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fold each row's checked digest with its proof: ``key``, leaf, subroot, root, proof_sha256, folded_root, verified; all in hex."""
    return proofs.select(
        key, *[as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(as_hex(F.col("siblings")), 256).alias("proof_sha256"),
        fold(F.col("checked"), F.col("siblings"), F.col("shape")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
