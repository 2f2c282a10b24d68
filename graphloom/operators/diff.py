"""Comparison of two runs: nodes, edges, ports, tools, files, findings, and what changed in sum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import metric_delta
from graphloom.schema import GraphFrames


def full_diff(base: DataFrame, comp: DataFrame, keys: list[str], values: dict[str, float], strict: bool = True) -> DataFrame:
    """Full outer comparison: status added, removed, modified or unchanged, and the names of changed values.

    ``values`` maps columns to the numeric change that is still equal. Nulls equal nulls.
    """
    b = base.select(*keys, F.lit(True).alias("in_base"), *[F.col(v).alias(f"base_{v}") for v in values])
    c = comp.select(*keys, F.lit(True).alias("in_comp"), *[F.col(v).alias(f"comp_{v}") for v in values])
    j = b.join(c, keys, "full_outer")
    differs = []
    for v, tolerance in values.items():
        x, y = F.col(f"base_{v}"), F.col(f"comp_{v}")
        other = ~x.eqNullSafe(y) if not tolerance else ~x.eqNullSafe(y) & ~F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        differs.append(F.when(other, F.lit(v)))
    both = F.col("in_base") & F.col("in_comp")
    changed = F.when(both, F.array_compact(F.array(*differs))).otherwise(F.expr("cast(array() as array<string>)"))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_comp").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    return j.withColumn("changed", changed).withColumn("status", status).drop("in_base", "in_comp")


def sanitised(g: GraphFrames) -> GraphFrames:
    """Input fit for a diff: blank ids get one by their position, blank names the id, numbers that aren't finite go, ends are texts."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    named = lambda what: F.when(blank("id"), F.concat(F.lit(f"{what}-synth-"), F.col("ord"))).otherwise(F.col("id"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    metrics = F.col("metrics")
    for f in ("duration_ms", "cost_usd", "retries", "repair_rounds"):
        metrics = metrics.withField(f, finite(F.col(f"metrics.{f}")))
    nodes = g.nodes.withColumn("metrics", F.when(F.col("metrics").isNotNull(), metrics)).withColumn("id", named("node"))
    nodes = nodes.withColumn("name", F.when(blank("name"), F.col("id")).otherwise(F.col("name")))
    edges = g.edges.withColumn("id", named("edge")).fillna("", ["source", "target"])
    return GraphFrames(nodes, edges, g.sections)


def _nodes(g: GraphFrames, duration: str, tokens: str) -> DataFrame:
    return g.nodes.select(
        "graph_id", "id", "name", M.STATUS.alias("state"), "kind", M.MODEL_DIFF.alias("model"), M.TIER.alias("tier"), "section_id", "step",
        M.DURATIONS[duration].alias("duration_ms"), M.TOKENS[tokens].alias("tokens"), M.REPAIRS.cast("double").alias("repairs"), M.COST.alias("cost"),
        F.coalesce(F.size("findings"), F.lit(0)).alias("findings"),
    )


def node_diff(base: GraphFrames, comp: GraphFrames, ms: float = 0, tokens: float = 0) -> DataFrame:
    """Twelve properties; ``is_structural`` if identity or shape changed, ``is_execution`` if only how it ran."""
    d = full_diff(_nodes(base, "dur_diff", "tok_diff"), _nodes(comp, "dur_diff", "tok_diff"), ["graph_id", "id"], {"name": 0, "state": 0, "kind": 0, "model": 0, "tier": 0, "section_id": 0, "step": 0, "duration_ms": ms, "tokens": tokens, "repairs": 0, "cost": 0, "findings": 0})
    shape = F.arrays_overlap("changed", F.array(*map(F.lit, ("name", "kind", "model", "tier", "section_id", "step"))))
    run = F.arrays_overlap("changed", F.array(*map(F.lit, ("state", "duration_ms", "tokens", "repairs", "cost", "findings"))))
    return d.withColumn("is_structural", F.col("status").isin("added", "removed") | shape).withColumn("is_execution", run)


def edge_diff(base: GraphFrames, comp: GraphFrames) -> DataFrame:
    """Eight edge properties; moved ends count."""
    pick = lambda g: g.edges.select("graph_id", "id", "source", "target", "label", "kind", "condition", F.coalesce("tokens", "traffic.tokens").alias("tokens"), F.col("traffic.status").alias("state"), F.coalesce(F.size("exchanges"), F.lit(0)).alias("exchanges"))
    return full_diff(pick(base), pick(comp), ["graph_id", "id"], dict.fromkeys(("source", "target", "label", "kind", "condition", "tokens", "state", "exchanges"), 0))


def compare_runs(base: GraphFrames, comp: GraphFrames) -> tuple[DataFrame, DataFrame]:
    """The second engine: seven node and four edge fields; moved ends are no change, percentages only from above 0."""
    n = full_diff(_nodes(base, "dur_compare", "tok_compare"), _nodes(comp, "dur_compare", "tok_compare"), ["graph_id", "id"], dict.fromkeys(("state", "kind", "model", "duration_ms", "tokens", "repairs", "findings"), 0))
    percent = F.when(F.col("base_duration_ms") > 0, (F.col("comp_duration_ms") - F.col("base_duration_ms")) / F.col("base_duration_ms") * 100)
    pick = lambda g: g.edges.select("graph_id", "id", "kind", F.coalesce("tokens", "traffic.tokens").alias("tokens"), F.coalesce(F.size("exchanges"), F.lit(0)).alias("exchanges"), "condition")
    return n.withColumn("duration_percent", percent), full_diff(pick(base), pick(comp), ["graph_id", "id"], dict.fromkeys(("kind", "tokens", "exchanges", "condition"), 0))


def tool_diff(base: GraphFrames, comp: GraphFrames) -> DataFrame:
    pick = lambda g: g.nodes.select("graph_id", "id", F.explode("tools").alias("t")).select("graph_id", "id", F.col("t.name").alias("tool"), F.col("t.category").alias("category")).dropDuplicates(["graph_id", "id", "tool"])
    return full_diff(pick(base), pick(comp), ["graph_id", "id", "tool"], {"category": 0})


def file_diff(base: GraphFrames, comp: GraphFrames) -> DataFrame:
    pick = lambda g: g.nodes.select("graph_id", "id", F.explode("files").alias("f")).select("graph_id", "id", "f.path", "f.mode", "f.additions", "f.deletions").dropDuplicates(["graph_id", "id", "path"])
    return full_diff(pick(base), pick(comp), ["graph_id", "id", "path"], {"mode": 0, "additions": 0, "deletions": 0})


def finding_diff(base: GraphFrames, comp: GraphFrames, by_node: bool = True) -> DataFrame:
    """Findings as repaired, new, regressed, persistent_open or persistent_resolved.

    With ``by_node`` they match within a node by id, else requirement, else observation, and one that is gone is
    repaired; without, they match by id anywhere, the last node's wins, and one that is gone is repaired only if open.
    """
    key = lambda f: F.coalesce(f["id"], f["requirement_id"], f["observation"])

    def pick(g: GraphFrames) -> DataFrame:
        f = g.nodes.select("graph_id", "id", "ord", F.posexplode("findings").alias("pos", "f"))
        f = f.select("graph_id", "id", "ord", "pos", key(F.col("f")).alias("finding"), (~F.coalesce(F.col("f.status"), F.lit("open")).isin("resolved", "repaired", "closed")).alias("is_open"))
        keys = ["graph_id", "id", "finding"] if by_node else ["graph_id", "finding"]
        return f.groupBy(*keys).agg(F.max_by("is_open", F.struct("ord", "pos")).alias("is_open"))

    keys = ["graph_id", "id", "finding"] if by_node else ["graph_id", "finding"]
    j = pick(base).withColumnRenamed("is_open", "was").join(pick(comp).withColumnRenamed("is_open", "now"), keys, "full_outer")
    gone = F.lit("repaired") if by_node else F.when(F.col("was"), "repaired").otherwise("persistent_resolved")
    status = (
        F.when(F.col("now").isNull(), gone).when(F.col("was").isNull(), F.when(F.col("now"), "new").otherwise("persistent_resolved"))
        .when(F.col("was") & ~F.col("now"), "repaired").when(~F.col("was") & F.col("now"), "regressed").when(F.col("now"), "persistent_open").otherwise("persistent_resolved")
    )
    return j.select(*keys, status.alias("status"))


def rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by status and deltas of the sums."""
    s = lambda v: F.count_if(F.col("status") == v).alias(v)
    n = nodes.groupBy("graph_id").agg(*[s(v) for v in ("added", "removed", "modified", "unchanged")], *[F.coalesce(F.sum(f"{side}_{c}"), F.lit(0.0)).alias(f"{side}_{c}") for side in ("base", "comp") for c in ("duration_ms", "tokens", "repairs", "cost")])
    e = edges.groupBy("graph_id").agg(*[F.count_if(F.col("status") == v).alias(f"edges_{v}") for v in ("added", "removed", "modified", "unchanged")])
    out = n.join(e, "graph_id", "full_outer")
    return reduce(lambda d, c: d.withColumn(f"{c}_change", metric_delta(F.col(f"base_{c}"), F.col(f"comp_{c}"))), ("duration_ms", "tokens", "repairs", "cost"), out)


def deep_equal(a: Column, b: Column) -> Column:
    """Equality of structures of any depth, nulls equal."""
    return F.to_json(F.struct(a.alias("x"))).eqNullSafe(F.to_json(F.struct(b.alias("x"))))
