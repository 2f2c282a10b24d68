"""Reachability, blast radius, components, clusters and subgraphs, by frontier joins over whole tables.

Every round is written to the shared scratch folder, so lineage stays short and lost executors cost only their tasks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import in_polygon, js_round
from graphloom.runtime import stage
from graphloom.schema import GraphFrames


def arcs(g: GraphFrames, direction: str = "down") -> DataFrame:
    """Distinct (graph_id, src, dst) between existing nodes, without self-loops, in the wanted direction."""
    e = g.valid_edges().filter("source <> target").select("graph_id", F.col("source").alias("src"), F.col("target").alias("dst"))
    back = e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"down": e, "up": back, "both": e.unionByName(back)}[direction].distinct()


def bfs(links: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """From each root (graph_id, root): every node reached with its depth and its smallest parent on a shortest path."""
    links = stage(links, "links")
    front = stage(roots.select("graph_id", "root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct(), "front")
    seen, depth = front, 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        step = front.select("graph_id", "root", F.col("id").alias("src")).join(links, ["graph_id", "src"])
        step = step.groupBy("graph_id", "root", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = step.join(seen.select("graph_id", "root", "id"), ["graph_id", "root", "id"], "left_anti")
        front = stage(fresh.select("graph_id", "root", "id", F.lit(depth).alias("depth"), "parent"), "front")
        seen = seen.unionByName(front)
    return seen


def closure(g: GraphFrames, roots: DataFrame, direction: str = "down", max_depth: int | None = None, include_roots: bool = True) -> DataFrame:
    """Nodes within reach of any root (graph_id, id), with the smallest depth.

    With a depth limit roots are always part of the result: they are added again when they are visited.
    """
    start = roots.select("graph_id", F.col("id").alias("root"))
    start = start.join(g.nodes.select("graph_id", F.col("id").alias("root")), ["graph_id", "root"], "left_semi")
    # One search from all roots of a graph at once: they share a made-up root.
    links = stage(arcs(g, direction), "links")
    front = stage(start.select("graph_id", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct(), "front")
    seen, depth = front, 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        step = front.select("graph_id", F.col("id").alias("src")).join(links, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id")).distinct()
        front = stage(step.join(seen, ["graph_id", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
    return seen if include_roots or max_depth else seen.filter("depth > 0")


def degrees(g: GraphFrames) -> DataFrame:
    """In, out and total degree of every node; terminals have no way out."""
    e = g.valid_edges()
    out = e.groupBy("graph_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_ = e.groupBy("graph_id", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    n = g.nodes.select("graph_id", "id").join(in_, ["graph_id", "id"], "left").join(out, ["graph_id", "id"], "left").fillna(0, ["in_degree", "out_degree"])
    return n.withColumn("degree", F.col("in_degree") + F.col("out_degree")).withColumn("is_terminal", F.col("out_degree") == 0)


def blast_radius(g: GraphFrames, roots: DataFrame | None = None) -> DataFrame:
    """What a failure of each node reaches: nodes, depth, terminals, score, level; fragility is the graph's mean score.

    Score: up to 50 for the reached share, 15 for depth 3 or more (8 for less), 5 a terminal up to 15, 15 for a hub (three
    or more direct successors, or an orchestrator, router or gate), 10 for a failure or retries on record.
    """
    roots = g.nodes.select("graph_id", F.col("id").alias("root")) if roots is None else roots.select("graph_id", F.col("id").alias("root"))
    reach = bfs(arcs(g), roots).filter("depth > 0")
    ends = degrees(g).select("graph_id", "id", "is_terminal")
    hit = reach.join(ends, ["graph_id", "id"]).groupBy("graph_id", "root").agg(F.count(F.lit(1)).alias("reached"), F.max("depth").alias("depth"), F.count_if("is_terminal").alias("terminals"), F.count_if(F.col("depth") == 1).alias("direct"))
    out = roots.join(hit, ["graph_id", "root"], "left").fillna(0, ["reached", "depth", "terminals", "direct"]).withColumnRenamed("root", "id")
    size = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size"))
    out = out.join(size, "graph_id").join(g.nodes.select("graph_id", "id", "status", "kind", F.coalesce(M.m["retries"], F.lit(0.0)).alias("retries")), ["graph_id", "id"])
    share = F.when(F.col("size") > 1, js_round(50 * F.col("reached") / (F.col("size") - 1))).otherwise(0)
    deep = F.when(F.col("depth") >= 3, 15).when(F.col("depth") >= 1, 8).otherwise(0)
    score = share + deep + F.least(F.lit(15), 5 * F.col("terminals")) + F.when((F.col("direct") > 2) | F.col("kind").isin("orchestrator", "router", "gate"), 15).otherwise(0) + F.when(F.col("status").isin("error", "warning") | (F.col("retries") > 0), 10).otherwise(0)
    out = out.withColumn("score", F.least(F.lit(100), score).cast("long"))
    level = F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 45, "high").when(F.col("score") >= 20, "medium").otherwise("low")
    fragility = js_round(F.avg("score").over(Window.partitionBy("graph_id"))).cast("long")
    return out.select("graph_id", "id", "reached", "depth", "terminals", "direct", "score", level.alias("level"), fragility.alias("fragility"))


def components(g: GraphFrames) -> DataFrame:
    """Weakly connected components: every node with the smallest id of its component."""
    links = stage(arcs(g, "both"), "links")
    labels = stage(g.nodes.select("graph_id", "id", F.col("id").alias("component")), "labels")
    while True:
        near = links.join(labels.select("graph_id", F.col("id").alias("dst"), F.col("component").alias("other")), ["graph_id", "dst"])
        near = near.groupBy("graph_id", F.col("src").alias("id")).agg(F.min("other").alias("other"))
        step = labels.join(near, ["graph_id", "id"], "left").select("graph_id", "id", F.col("component").alias("old"), F.least("component", "other").alias("component"))
        jump = labels.select("graph_id", F.col("id").alias("component"), F.col("component").alias("next"))
        step = stage(step.join(jump, ["graph_id", "component"]).select("graph_id", "id", "old", F.least("component", "next").alias("component")), "labels")
        labels = step.select("graph_id", "id", "component")
        if step.filter("old <> component").isEmpty():
            return labels


def clusters(g: GraphFrames, strategy: str = "subtree") -> DataFrame:
    """Clusters by subtree, section, agent or kind.

    Subtree: each node joins the nearest root (no way in, or an orchestrator), of equally near ones the first by input;
    searches don't cross other roots, and nodes that no root reaches are clusters of their own.
    """
    n = g.nodes
    if strategy != "subtree":
        key = {"section": F.coalesce("section_id", "group", F.lit("unassigned")), "agent": F.coalesce("telemetry.agent_id", "host_agent.name", F.lit("unassigned")), "kind": M.KIND}[strategy]
        return n.select("graph_id", "id", key.alias("cluster"), F.lit(0).alias("distance"))
    has_in = arcs(g).select("graph_id", F.col("dst").alias("id")).distinct()
    roots = n.join(has_in, ["graph_id", "id"], "left_anti").select("graph_id", "id", "ord").unionByName(n.filter("kind = 'orchestrator'").select("graph_id", "id", "ord")).distinct()
    links = stage(arcs(g).join(roots.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_anti"), "links")
    front = stage(roots.select("graph_id", "id", F.struct("ord", F.col("id").alias("root")).alias("by"), F.lit(0).alias("distance")), "front")
    seen, distance = front, 0
    while not front.isEmpty():
        distance += 1
        step = front.select("graph_id", F.col("id").alias("src"), "by").join(links, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.min("by").alias("by"))
        front = stage(step.join(seen.select("graph_id", "id"), ["graph_id", "id"], "left_anti").withColumn("distance", F.lit(distance)), "front")
        seen = seen.unionByName(front)
    out = n.select("graph_id", "id").join(seen, ["graph_id", "id"], "left")
    return out.select("graph_id", "id", F.coalesce("by.root", "id").alias("cluster"), F.coalesce("distance", F.lit(0)).alias("distance"))


def chosen(g: GraphFrames, mode: str = "all", ids=(), sections=(), polygon=(), boxes: DataFrame | None = None, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """Nodes (graph_id, id) of a subgraph: ``all``; a ``selection`` of ids; the ``closure`` of ids; those of ``section``s;
    those whose box (graph_id, id, x, y, width, height) has its centre in a ``polygon`` of three points at least."""
    nodes = g.nodes.select("graph_id", "id")
    picked = nodes.filter(F.col("id").isin(*ids)) if ids else nodes.limit(0)
    if mode == "all":
        return nodes
    if mode == "selection":
        return picked
    if mode == "closure":
        return closure(g, picked, direction, max_depth).select("graph_id", "id")
    if mode == "section":
        if g.sections is None:
            return g.nodes.filter(F.col("section_id").isin(*sections)).select("graph_id", "id")
        inside = g.sections.filter(F.col("id").isin(*sections)).select("graph_id", F.explode("node_ids").alias("id"))
        return nodes.join(inside.distinct(), ["graph_id", "id"], "left_semi")
    if mode == "polygon":
        if boxes is None or len(polygon) < 3:
            return nodes.limit(0)
        centre = in_polygon(F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2, list(polygon))
        return nodes.join(boxes.filter(centre), ["graph_id", "id"], "left_semi")
    raise ValueError(f"no mode {mode}")


def pruned_sections(g: GraphFrames, chosen: DataFrame) -> DataFrame:
    """The sections with the chosen ones of their nodes, in their order; sections left without any go."""
    s = g.sections.select("graph_id", F.col("id").alias("section"), F.posexplode("node_ids").alias("pos", "id"))
    kept = s.join(chosen.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi")
    return kept.groupBy("graph_id", F.col("section").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("node_ids"))


def minimap_groups(g: GraphFrames) -> DataFrame:
    """Groups (graph_id, id, cluster) of a minimap: by section or group; of the other nodes the weak components among
    themselves, by their smallest id. A node alone is left out, unless it is the graph's only one without a section."""
    n = g.nodes.select("graph_id", "id", F.coalesce("section_id", "group").alias("cluster"))
    loose = g.nodes.filter("coalesce(section_id, `group`) is null")
    found = components(GraphFrames(loose, g.edges)).withColumnRenamed("component", "cluster")
    size, all_ = Window.partitionBy("graph_id", "cluster"), Window.partitionBy("graph_id")
    found = found.withColumns({"size": F.count(F.lit(1)).over(size), "loose": F.count(F.lit(1)).over(all_)})
    return n.filter("cluster is not null").unionByName(found.filter("size > 1 or loose = 1").select("graph_id", "id", "cluster"))


def subgraph(g: GraphFrames, chosen: DataFrame, boundary: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Chosen nodes (graph_id, id), and their edges as internal, incoming or outgoing.

    ``boundary``: drop the edges that cross, keep them all, or keep the ``incoming`` or the ``outgoing`` ones.
    """
    ids = chosen.select("graph_id", "id").distinct()
    nodes = g.nodes.join(ids, ["graph_id", "id"], "left_semi")
    a, b = ids.select("graph_id", F.col("id").alias("source"), F.lit(True).alias("has_source")), ids.select("graph_id", F.col("id").alias("target"), F.lit(True).alias("has_target"))
    e = g.edges.join(a, ["graph_id", "source"], "left").join(b, ["graph_id", "target"], "left")
    role = F.when(F.col("has_source") & F.col("has_target"), "internal").when(F.col("has_target"), "incoming").when(F.col("has_source"), "outgoing")
    e = e.withColumn("role", role).filter("role is not null").drop("has_source", "has_target")
    return nodes, e if boundary == "keep" else e.filter(F.col("role").isin("internal", boundary))


def subgraph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and sums of a subgraph; here absent costs count as 0, and declared totals add to the parts."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(M.TOKENS["tok_subgraph"]).alias("tokens"), F.sum(M.DURATIONS["dur_diff"]).alias("duration_ms"), js_round(F.sum(F.coalesce(M.COST, F.lit(0.0))), 4).alias("cost"))
    e = edges.groupBy("graph_id", "role").agg(F.count(F.lit(1)).alias("c")).groupBy("graph_id").pivot("role", ["internal", "incoming", "outgoing"]).agg(F.first("c")).fillna(0)
    return n.join(e, "graph_id", "left").fillna(0, ["internal", "incoming", "outgoing"])


def section_depth(g: GraphFrames, sections: DataFrame) -> DataFrame:
    """Nesting depth of sections by the section of their parent node; a cycle ends at the section it began with."""
    parent = sections.select("graph_id", F.col("id").alias("section"), F.col("parent_node_id").alias("id"))
    up = parent.join(g.nodes.select("graph_id", "id", F.col("section_id").alias("outer")), ["graph_id", "id"]).filter("outer is not null and outer <> section")
    reach = bfs(up.select("graph_id", F.col("section").alias("src"), F.col("outer").alias("dst")), sections.select("graph_id", F.col("id").alias("root")))
    return reach.groupBy("graph_id", F.col("root").alias("id")).agg(F.max("depth").alias("depth"))


def dangling_edges(g: GraphFrames) -> DataFrame:
    """Edges with an end that isn't a node, naming which."""
    for_ = lambda end: g.nodes.select("graph_id", F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
    e = g.edges.join(for_("source"), ["graph_id", "source"], "left").join(for_("target"), ["graph_id", "target"], "left")
    missing = F.concat_ws(",", F.when(F.col("has_source").isNull(), "source"), F.when(F.col("has_target").isNull(), "target"))
    return e.select("graph_id", "id", "source", "target", missing.alias("missing")).filter("missing <> ''")


def orphans(g: GraphFrames) -> DataFrame:
    """Nodes without any edge."""
    touched = g.edges.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return g.nodes.select("graph_id", "id").join(touched, ["graph_id", "id"], "left_anti")


def longest_paths(g: GraphFrames, duration: str = "dur_analytics") -> DataFrame:
    """On acyclic graphs of any size: for each node the longest sum of durations of a path that ends there.

    Nodes settle level by level, when all their predecessors have; nodes on or behind cycles never do and are left out.
    """
    links = stage(arcs(g), "links")
    n = stage(g.nodes.select("graph_id", "id", M.DURATIONS[duration].alias("ms")), "nodes")
    open_in = links.groupBy("graph_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    state = stage(n.join(open_in, ["graph_id", "id"], "left").fillna(0, ["open"]).withColumn("best", F.lit(0.0)), "state")
    done = None
    for level in itertools.count():
        ready = stage(state.filter("open = 0").select("graph_id", "id", (F.col("ms") + F.col("best")).alias("total_ms"), F.lit(level).alias("level")), "ready")
        done = ready if done is None else done.unionByName(ready)
        if ready.isEmpty():
            break
        told = ready.select("graph_id", F.col("id").alias("src"), "total_ms").join(links, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("id")).agg(F.max("total_ms").alias("came"), F.count(F.lit(1)).alias("told"))
        rest = state.filter("open > 0").join(told, ["graph_id", "id"], "left")
        state = stage(rest.select("graph_id", "id", "ms", (F.col("open") - F.coalesce("told", F.lit(0))).alias("open"), F.greatest("best", F.coalesce("came", F.lit(0.0))).alias("best")), "state")
    return done


def fallback_routes(g: GraphFrames, dead: DataFrame) -> DataFrame:
    """For each dead node (graph_id, id) the first other live node of its kind by input order, null if there is none."""
    d = dead.join(g.nodes.select("graph_id", "id", M.KIND.alias("kind")), ["graph_id", "id"])
    live = g.nodes.filter(~F.coalesce("status", F.lit("")).isin("error", "skipped")).join(dead, ["graph_id", "id"], "left_anti")
    live = live.groupBy("graph_id", M.KIND.alias("kind")).agg(F.min_by("id", "ord").alias("fallback"))
    return d.join(live, ["graph_id", "kind"], "left").select("graph_id", "id", "fallback")
