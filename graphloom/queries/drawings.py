"""Queries of layered drawings over graphs with branches, joins, long edges and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import drawing, layout
from graphloom.queries.registry import query
from graphloom.runtime import stage
from graphloom.schema import GraphFrames
from graphloom.sources.adapters import ctes, graph

LOYAL, RELAY = ("WITH RECURSIVE " + ctes(x) for x in ("loyal", "relay"))


def _gates(spark, sf_dir, name):
    g = graph(spark, sf_dir, name)
    # The scan reads both many times.
    g = GraphFrames(stage(g.nodes, "nodes"), stage(g.edges, "edges"))
    v = layout.gate_scan(g, *drawing.layered_drawing(g))
    gates = [c for c in v.columns if c != "graph_id"]
    return v.select("graph_id", sum((F.col(c) for c in gates[1:]), F.col(gates[0])).alias("violations"))


@query(f"{RELAY} SELECT graph_id, 0::BIGINT AS violations FROM nodes GROUP BY 1")
def layout_gates_relay(spark, sf_dir):
    """Eight hard constraints of the drawings of acyclic graphs with branches and long edges."""
    return _gates(spark, sf_dir, "relay")


@query(f"{LOYAL} SELECT graph_id, 0::BIGINT AS violations FROM nodes GROUP BY 1")
def layout_gates_loyal(spark, sf_dir):
    """The same of cyclic graphs, some of whose edges run upwards."""
    return _gates(spark, sf_dir, "loyal")


@query()
def layered_relay(spark, sf_dir):
    return drawing.layered_layout(graph(spark, sf_dir, "relay"))


@query(f"{RELAY} SELECT graph_id, count(*) AS edges, count(*) AS routed, count(DISTINCT source) AS sources FROM edges GROUP BY 1")
def relay_ports(spark, sf_dir):
    """Edges, edges whose two ports no other edge has, and nodes that edges leave at the bottom."""
    r = stage(drawing.routes(graph(spark, sf_dir, "relay")), "routes")
    e = r.join(graph(spark, sf_dir, "relay").edges.select("graph_id", "id", "source", "target"), ["graph_id", "id"])
    out, in_ = F.struct("source", "out_side", "out_port"), F.struct("target", "in_side", "in_port")
    lone = F.least(F.countDistinct(out), F.countDistinct(in_)).alias("routed")
    return e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), lone, F.countDistinct(F.when(F.col("out_side") == "bottom", F.col("source"))).alias("sources"))


@query(f"{LOYAL} SELECT graph_id, id, 'handoff' AS text, 61.0::DOUBLE AS width, true AS is_on_route FROM edges")
def edge_badges(spark, sf_dir):
    """Badges of all edges, and whether each lies on its own route."""
    g = graph(spark, sf_dir, "loyal")
    r = stage(drawing.routes(g), "routes")
    b = drawing.badges(g, r)
    s = layout.segments_of(r)
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    near = lambda v, a, c: (v >= F.least(a, c) - 1e-6) & (v <= F.greatest(a, c) + 1e-6)
    on = b.join(s, ["graph_id", "id"]).groupBy("graph_id", "id").agg(F.bool_or(near(cx, F.col("ax"), F.col("bx")) & near(cy, F.col("ay"), F.col("by"))).alias("is_on_route"))
    return b.join(on, ["graph_id", "id"]).select("graph_id", "id", "text", "width", "is_on_route")
