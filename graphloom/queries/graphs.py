"""Queries of graph operators: traversal, paths, layout phases, exports, over graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import collab, drawing, layout, levels, paths, traverse
from graphloom.queries.registry import query, rounded
from graphloom.runtime import stage
from graphloom.schema import GraphFrames
from graphloom.sources import export
from graphloom.sources.adapters import ctes, graph, spark_sql

SUPPLY = "WITH RECURSIVE " + ctes("supply")
LOYAL = "WITH RECURSIVE " + ctes("loyal")
RELAY = "WITH RECURSIVE " + ctes("relay")
TYPES = "WITH " + ctes("transition")
TALK = "WITH RECURSIVE " + ctes("conversation")


def _roots(g, *ids):
    return g.nodes.filter(F.col("id").isin(*ids)).select("graph_id", "id")


@query(f"""{SUPPLY}, r(id, depth) AS (SELECT 'r1', 0 UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id WHERE e.source <> e.target AND r.depth < 3)
    SELECT 'supply' AS graph_id, id, min(depth)::INTEGER AS depth FROM r GROUP BY id""")
def closure_down(spark, sf_dir):
    g = graph(spark, sf_dir, "supply")
    return traverse.closure(g, _roots(g, "r1"), "down", max_depth=3)


@query(f"""{LOYAL}, start AS (SELECT graph_id, min(id) AS id FROM nodes GROUP BY 1), r(graph_id, id) AS (SELECT graph_id, id FROM start UNION SELECT r.graph_id, e.target FROM r JOIN edges e ON e.graph_id = r.graph_id AND e.source = r.id) SELECT graph_id, id FROM r""")
def closure_on_cycles(spark, sf_dir):
    g = graph(spark, sf_dir, "loyal")
    first = g.nodes.groupBy("graph_id").agg(F.min("id").alias("id"))
    return traverse.closure(g, first, "down").select("graph_id", "id")


@query(f"""{SUPPLY} SELECT n.graph_id, n.id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree, coalesce(o.k, 0) = 0 AS is_terminal FROM nodes n
    LEFT JOIN (SELECT target AS id, count(*) AS k FROM edges GROUP BY 1) i USING (id) LEFT JOIN (SELECT source AS id, count(*) AS k FROM edges GROUP BY 1) o USING (id)""")
def degrees(spark, sf_dir):
    return traverse.degrees(graph(spark, sf_dir, "supply"))


_BLAST = """, step(graph_id, root, id, depth) AS (SELECT graph_id, id, id, 0 FROM nodes UNION SELECT s.graph_id, s.root, e.target, s.depth + 1 FROM step s JOIN edges e ON e.graph_id = s.graph_id AND e.source = s.id WHERE e.source <> e.target AND s.depth < 60),
    reach AS (SELECT graph_id, root, id, min(depth) AS depth FROM step GROUP BY 1, 2, 3), ends AS (SELECT n.graph_id, n.id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.source = n.id)),
    hit AS (SELECT r.graph_id, root AS id, count(*) AS reached, max(depth) AS depth, count(ends.id) AS terminals, count(*) FILTER (depth = 1) AS direct FROM reach r LEFT JOIN ends ON ends.graph_id = r.graph_id AND ends.id = r.id WHERE depth > 0 GROUP BY 1, 2),
    s AS (SELECT n.graph_id, n.id, coalesce(reached, 0) AS reached, coalesce(depth, 0)::INTEGER AS depth, coalesce(terminals, 0) AS terminals, coalesce(direct, 0) AS direct, n.status, n.kind, count(*) OVER (PARTITION BY n.graph_id) AS size FROM nodes n LEFT JOIN hit USING (graph_id, id)),
    x AS (SELECT *, least(100, (CASE WHEN size > 1 THEN floor(50 * reached / (size - 1)::DOUBLE + 0.5) ELSE 0 END + CASE WHEN depth >= 3 THEN 15 WHEN depth >= 1 THEN 8 ELSE 0 END + least(15, 5 * terminals) + CASE WHEN direct > 2 OR kind IN ('orchestrator', 'router', 'gate') THEN 15 ELSE 0 END + CASE WHEN status IN ('error', 'warning') THEN 10 ELSE 0 END))::BIGINT AS score FROM s)
    SELECT graph_id, id, reached, depth, terminals, direct, score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level, floor(avg(score) OVER (PARTITION BY graph_id) + 0.5)::BIGINT AS fragility FROM x"""


@query(RELAY + _BLAST)
def blast_radius(spark, sf_dir):
    return traverse.blast_radius(graph(spark, sf_dir, "relay"))


@query(f"""{LOYAL}, both_ AS (SELECT graph_id, source AS a, target AS b FROM edges UNION SELECT graph_id, target, source FROM edges), r(graph_id, id, to_) AS (SELECT graph_id, id, id FROM nodes UNION SELECT r.graph_id, r.id, b.b FROM r JOIN both_ b ON b.graph_id = r.graph_id AND b.a = r.to_)
    SELECT graph_id, id, min(to_) AS component FROM r GROUP BY 1, 2""")
def weak_components(spark, sf_dir):
    return traverse.components(graph(spark, sf_dir, "loyal"))


_REACH = "r(graph_id, a, b) AS (SELECT graph_id, source, target FROM edges UNION SELECT r.graph_id, r.a, e.target FROM r JOIN edges e ON e.graph_id = r.graph_id AND e.source = r.b)"


@query(f"""{LOYAL}, {_REACH}, mutual AS (SELECT x.graph_id, x.a, x.b FROM r x JOIN r y ON x.graph_id = y.graph_id AND x.a = y.b AND x.b = y.a),
    c AS (SELECT n.graph_id, n.id, coalesce(least(min(m.b), n.id), n.id) AS component, count(m.b) > 0 AS is_cyclic FROM nodes n LEFT JOIN mutual m ON m.graph_id = n.graph_id AND m.a = n.id GROUP BY 1, 2)
    SELECT graph_id, id, component, (count(*) OVER (PARTITION BY graph_id, component))::INTEGER AS size, is_cyclic FROM c""")
def strong_components(spark, sf_dir):
    return paths.strong_components(graph(spark, sf_dir, "loyal"))


@query()
def cycle_list(spark, sf_dir):
    return paths.cycles(graph(spark, sf_dir, "loyal"))


@query(f"""{LOYAL}, {_REACH}, c AS (SELECT DISTINCT graph_id FROM r WHERE a = b) SELECT DISTINCT n.graph_id, c.graph_id IS NOT NULL AS is_cyclic, 0::BIGINT AS broken, 0::BIGINT AS left_over FROM nodes n LEFT JOIN c USING (graph_id)""")
def cyclic_graphs(spark, sf_dir):
    """Graphs with cycles by the cycle list; listed steps that are no edges; nodes that cycles hold once feedback edges are out."""
    g = graph(spark, sf_dir, "loyal")
    rings = stage(paths.cycles(g), "rings")
    steps = rings.select("graph_id", F.explode(F.transform("ids", lambda x, i: F.struct(x.alias("source"), F.coalesce(F.get("ids", i + 1), F.get("ids", F.lit(0))).alias("target")))).alias("s")).select("graph_id", "s.*")
    broken = steps.join(g.edges, ["graph_id", "source", "target"], "left_anti").groupBy("graph_id").agg(F.count(F.lit(1)).alias("broken"))
    back = paths.feedback_edges(g).filter("is_feedback").select("graph_id", "id")
    order = paths.topological_order(GraphFrames(g.nodes, g.edges.join(back, ["graph_id", "id"], "left_anti")))
    left = order.groupBy("graph_id").agg(F.count_if("is_residual").alias("left_over"))
    has = rings.groupBy("graph_id").agg(F.lit(True).alias("is_cyclic"))
    return left.join(has, "graph_id", "left").join(broken, "graph_id", "left").fillna(0, ["broken"]).select("graph_id", F.coalesce("is_cyclic", F.lit(False)).alias("is_cyclic"), "broken", "left_over")


@query()
def feedback_edges(spark, sf_dir):
    return paths.feedback_edges(graph(spark, sf_dir, "loyal"))


@query(f"""{LOYAL}, {_REACH}, c AS (SELECT graph_id, a AS id FROM r WHERE a = b), stuck AS (SELECT graph_id, id FROM c UNION SELECT r.graph_id, r.b FROM r JOIN c ON c.graph_id = r.graph_id AND c.id = r.a)
    SELECT n.graph_id, n.id, s.id IS NOT NULL AS is_residual FROM nodes n LEFT JOIN stuck s ON s.graph_id = n.graph_id AND s.id = n.id""")
def topological_residuals(spark, sf_dir):
    """Nodes on or behind cycles, which no topological order places."""
    return paths.topological_order(graph(spark, sf_dir, "loyal")).select("graph_id", "id", "is_residual")


@query(f"""{RELAY}, n AS (SELECT graph_id, count(*) AS nodes FROM nodes GROUP BY 1), e AS (SELECT graph_id, count(*) AS edges FROM edges GROUP BY 1)
    SELECT n.graph_id, nodes AS places, (nodes - 1)::INTEGER AS last_place, coalesce(edges, 0) AS edges_in_order FROM n LEFT JOIN e USING (graph_id)""")
def topological_order(spark, sf_dir):
    """Over acyclic graphs: as many places as nodes, and every edge runs from a smaller place to a larger one."""
    g = graph(spark, sf_dir, "relay")
    order = stage(paths.topological_order(g), "order")
    at = lambda end: order.select("graph_id", F.col("id").alias(end), F.col("place").alias(f"{end}_place"))
    e = g.edges.join(at("source"), ["graph_id", "source"]).join(at("target"), ["graph_id", "target"])
    e = e.groupBy("graph_id").agg(F.count_if(F.col("source_place") < F.col("target_place")).alias("edges_in_order"))
    n = order.filter("not is_residual").groupBy("graph_id").agg(F.countDistinct("place").alias("places"), F.max("place").alias("last_place"))
    return n.join(e, "graph_id", "left").fillna(0, ["edges_in_order"])


_HEAVIEST = f"""{RELAY}, p(graph_id, id, total, way) AS (SELECT graph_id, id, duration_ms, [id] FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.target = n.id)
    UNION ALL SELECT p.graph_id, e.target, p.total + n.duration_ms, list_append(p.way, e.target) FROM p JOIN edges e ON e.graph_id = p.graph_id AND e.source = p.id JOIN nodes n ON n.graph_id = e.graph_id AND n.id = e.target)"""
_CRITICAL = f"""{_HEAVIEST}, top AS (SELECT graph_id, arg_max(way, total) AS way FROM p GROUP BY 1), s AS (SELECT graph_id, unnest(way) AS id, unnest(range(len(way))) AS k FROM top), r AS (SELECT s.graph_id, s.id, k, duration_ms AS ms FROM s JOIN nodes n ON n.graph_id = s.graph_id AND n.id = s.id)
    SELECT graph_id, k::INTEGER AS position, id, round(ms, 4) AS ms, round(sum(ms) OVER w, 4) AS running_ms, round(ms / sum(ms) OVER (PARTITION BY graph_id) * 100, 4) AS share FROM r WINDOW w AS (PARTITION BY graph_id ORDER BY k)"""


@query(_CRITICAL)
def critical_path_analytics(spark, sf_dir):
    return rounded(paths.critical_path(graph(spark, sf_dir, "relay"), "analytics"))


@query(_CRITICAL)
def critical_path_anomaly(spark, sf_dir):
    return rounded(paths.critical_path(graph(spark, sf_dir, "relay"), "anomaly"))


@query(f"{_HEAVIEST} SELECT graph_id, round(max(total), 4) AS critical_ms FROM p GROUP BY 1")
def critical_ms_report(spark, sf_dir):
    return rounded(paths.critical_ms(graph(spark, sf_dir, "relay"), "report"))


@query(f"""{_HEAVIEST}, t AS (SELECT graph_id, max(total) AS ms, arg_max(len(way), total) AS k FROM p GROUP BY 1)
    SELECT n.graph_id, count(*) AS total_nodes, count(*) FILTER (status = 'error') AS failure, round(any_value(ms), 4) AS critical_ms, any_value(k) AS critical_nodes FROM nodes n JOIN t USING (graph_id) GROUP BY 1""")
def kpi_critical(spark, sf_dir):
    """The scorecard with its critical-path measures, over branching graphs."""
    from graphloom.operators.analytics import kpi_scorecard

    return rounded(kpi_scorecard(graph(spark, sf_dir, "relay")).select("graph_id", "total_nodes", "failure", "critical_ms", "critical_nodes"))


@query(f"""{RELAY}, m AS (SELECT graph_id, id, greatest(1.0, duration_ms) AS ms FROM nodes),
    f(graph_id, id, begun) AS (SELECT graph_id, id, 0.0::DOUBLE FROM m UNION SELECT f.graph_id, e.target, f.begun + m.ms FROM f JOIN m ON m.graph_id = f.graph_id AND m.id = f.id JOIN edges e ON e.graph_id = f.graph_id AND e.source = f.id),
    b(graph_id, id, rest) AS (SELECT graph_id, id, 0.0::DOUBLE FROM m UNION SELECT b.graph_id, e.source, b.rest + m.ms FROM b JOIN m ON m.graph_id = b.graph_id AND m.id = b.id JOIN edges e ON e.graph_id = b.graph_id AND e.target = b.id),
    t AS (SELECT graph_id, id, ms, (SELECT max(begun) FROM f WHERE f.graph_id = m.graph_id AND f.id = m.id) AS start, (SELECT max(rest) FROM b WHERE b.graph_id = m.graph_id AND b.id = m.id) AS rest FROM m),
    l AS (SELECT *, max(start + ms) OVER g - rest - ms - start AS slack FROM t WINDOW g AS (PARTITION BY graph_id))
    SELECT graph_id, id, round(start, 3) AS early_start, round(start + ms, 3) AS early_finish, abs(round(slack, 3)) AS slack, slack <= greatest(1.0, min(slack) OVER (PARTITION BY graph_id) + 2) AS is_critical FROM l""")
def schedule_cpm(spark, sf_dir):
    out = paths.schedule(graph(spark, sf_dir, "relay")).withColumn("slack", F.abs(F.round("slack", 3)))
    return rounded(out.select("graph_id", "id", "early_start", "early_finish", "slack", "is_critical"), 3)


@query(f"""{SUPPLY}, p(id, total, level) AS (SELECT id, duration_ms, 0 FROM nodes WHERE id NOT IN (SELECT target FROM edges)
    UNION SELECT e.target, p.total + n.duration_ms, p.level + 1 FROM p JOIN edges e ON e.source = p.id JOIN nodes n ON n.id = e.target)
    SELECT 'supply' AS graph_id, id, round(max(total), 4) AS total_ms, max(level)::INTEGER AS level FROM p GROUP BY id""")
def longest_paths(spark, sf_dir):
    return rounded(traverse.longest_paths(graph(spark, sf_dir, "supply")))


@query(f"""{SUPPLY}, r(id, cluster, ro, d) AS (SELECT id, id, ord, 0 FROM nodes WHERE kind = 'orchestrator' OR id NOT IN (SELECT target FROM edges)
    UNION SELECT e.target, r.cluster, r.ro, r.d + 1 FROM r JOIN edges e ON e.source = r.id JOIN nodes n ON n.id = e.target WHERE n.kind <> 'orchestrator'),
    b AS (SELECT id, cluster, d, row_number() OVER (PARTITION BY id ORDER BY d, ro) AS k FROM r) SELECT 'supply' AS graph_id, id, cluster, d::INTEGER AS distance FROM b WHERE k = 1""")
def subtree_clusters(spark, sf_dir):
    return traverse.clusters(graph(spark, sf_dir, "supply"))


@query(f"""{SUPPLY}, c AS (SELECT id FROM nodes WHERE kind IN ('agent', 'task')), e AS (SELECT e.*, s.id IS NOT NULL AS hs, t.id IS NOT NULL AS ht FROM edges e LEFT JOIN c s ON s.id = e.source LEFT JOIN c t ON t.id = e.target)
    SELECT graph_id, id, source, target, CASE WHEN hs AND ht THEN 'internal' WHEN ht THEN 'incoming' ELSE 'outgoing' END AS role FROM e WHERE hs OR ht""")
def subgraph_edges(spark, sf_dir):
    g = graph(spark, sf_dir, "supply")
    return traverse.subgraph(g, g.nodes.filter(F.col("kind").isin("agent", "task")), "keep")[1].select("graph_id", "id", "source", "target", "role")


@query(f"""{RELAY} SELECT graph_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND n.id IN (e.source, e.target))""")
def orphan_nodes(spark, sf_dir):
    return traverse.orphans(graph(spark, sf_dir, "relay"))


@query(f"""{SUPPLY}, c AS (SELECT * FROM nodes WHERE kind <> 'artifact') SELECT e.graph_id, e.id, e.source, e.target, 'target' AS missing FROM edges e WHERE e.target NOT IN (SELECT id FROM c)""")
def dangling_edges(spark, sf_dir):
    g = graph(spark, sf_dir, "supply")
    return traverse.dangling_edges(GraphFrames(g.nodes.filter("kind <> 'artifact'"), g.edges))


@query(f"""{LOYAL}, {_REACH}, h AS (SELECT r.graph_id, a, list(b) AS below, count(*) AS hit FROM r JOIN nodes n ON n.graph_id = r.graph_id AND n.id = r.a WHERE n.status = 'error' AND a <> b GROUP BY 1, 2)
    SELECT h.graph_id, array_to_string(list_sort(list_append(below, a)), ',') AS nodes, hit::DOUBLE AS value, CASE WHEN hit >= 3 OR hit / (SELECT count(*) FROM nodes n WHERE n.graph_id = h.graph_id)::DOUBLE >= 0.35 THEN 'critical' ELSE 'error' END AS severity FROM h""")
def error_cascades(spark, sf_dir):
    """Each failed customer with what lies downstream of it."""
    from graphloom.operators import anomaly

    out = anomaly.error_cascades(graph(spark, sf_dir, "loyal"), anomaly.Limits())
    return out.select("graph_id", F.array_join("node_ids", ",").alias("nodes"), "value", "severity")


@query(f"""{TYPES} SELECT source, target, tokens AS transitions, round(latency_ms, 2) AS avg_gap_ms FROM edges""")
def transition_heat(spark, sf_dir):
    e = graph(spark, sf_dir, "transition").edges
    return e.select("source", "target", F.col("traffic.tokens").alias("transitions"), F.round("traffic.avg_latency_ms", 2).alias("avg_gap_ms"))


# ---- layout


@query(f"""{SUPPLY}, p(id, level) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT target FROM edges) UNION SELECT e.target, p.level + 1 FROM p JOIN edges e ON e.source = p.id) SELECT 'supply' AS graph_id, id, max(level)::INTEGER AS rank FROM p GROUP BY id""")
def longest_path_ranks(spark, sf_dir):
    return levels.level_ranks(graph(spark, sf_dir, "supply"))


@query(f"{LOYAL} SELECT graph_id, count(*) AS edges, 0::BIGINT AS violations FROM edges GROUP BY 1")
def tight_rank_violations(spark, sf_dir):
    """Edges of the acyclic order that run less than their least length down: none."""
    g = graph(spark, sf_dir, "loyal")
    r = layout.rank_table(g, "tight")
    e = paths.feedback_edges(g).join(g.edges.select("graph_id", "id", "source", "target"), ["graph_id", "id"])
    e = e.join(r.select("graph_id", F.col("id").alias("source"), F.col("rank").alias("a")), ["graph_id", "source"]).join(r.select("graph_id", F.col("id").alias("target"), F.col("rank").alias("b")), ["graph_id", "target"])
    span = F.when(F.col("is_feedback"), F.col("a") - F.col("b")).otherwise(F.col("b") - F.col("a"))
    return e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(span < 1).alias("violations"))


@query(f"""{SUPPLY}, w AS (SELECT graph_id, id, ord, row_number() OVER (ORDER BY ord) - 1 AS i, ceil(sqrt(count(*) OVER ())) AS per FROM nodes) SELECT graph_id, id, ((i % per) * 160.0)::DOUBLE AS x, (floor(i / per) * 140.0)::DOUBLE AS y FROM w""")
def grid_layout(spark, sf_dir):
    return layout.grid_layout(graph(spark, sf_dir, "supply"))


@query()
def layered_layout(spark, sf_dir):
    return drawing.layered_layout(graph(spark, sf_dir, "conversation"))


@query()
def edge_routes(spark, sf_dir):
    return drawing.routes(graph(spark, sf_dir, "conversation"))


@query()
def force_layout(spark, sf_dir):
    return layout.force_layout(graph(spark, sf_dir, "transition"))


@query("SELECT 0::BIGINT AS box_overlaps, 0::BIGINT AS routes_through_boxes, count(DISTINCT conv_id) AS graphs FROM conversations")
def layout_constraints(spark, sf_dir):
    """Hard constraints of the layered layout and its routes, over all conversation graphs: nothing overlaps."""
    g = graph(spark, sf_dir, "conversation")
    v = layout.constraint_scan(drawing.layered_layout(g), drawing.routes(g))
    return v.agg(F.sum("box_overlaps").alias("box_overlaps"), F.sum("routes_through_boxes").alias("routes_through_boxes"), F.count(F.lit(1)).alias("graphs"))


@query()
def layout_metrics(spark, sf_dir):
    g = graph(spark, sf_dir, "conversation")
    return layout.layout_metrics(drawing.layered_layout(g), drawing.routes(g))


@query()
def crossing_search(spark, sf_dir):
    return layout.crossing_search(graph(spark, sf_dir, "loyal"))


_SEG = "SELECT 'g' AS graph_id, c_nationkey AS rank, c_custkey % 97 AS u, c_custkey % 89 AS v FROM {customer}"


@query(f"""WITH s AS ({_SEG.replace("{customer}", "customer")}) SELECT 'g' AS graph_id, a.rank, count(*) AS crossings FROM s a JOIN s b ON a.rank = b.rank AND a.u < b.u AND a.v > b.v GROUP BY a.rank""")
def layer_crossings(spark, sf_dir):
    return layout.crossings(spark_sql(spark, sf_dir, _SEG))


_LANE = "SELECT 'g' AS graph_id, CAST(p_size AS BIGINT) AS channel, CAST(p_partkey % 100 AS DOUBLE) AS lo, CAST(p_partkey % 100 + p_size AS DOUBLE) AS hi FROM {part}"


@query(f"""WITH i AS ({_LANE.replace("{part}", "part")}), p AS (SELECT channel, lo AS t, 0 AS k, 1 AS d FROM i UNION ALL SELECT channel, hi, 1, -1 FROM i), r AS (SELECT channel, sum(d) OVER (PARTITION BY channel ORDER BY t, k) AS o FROM p) SELECT 'g' AS graph_id, channel, max(o)::BIGINT AS lanes FROM r GROUP BY 2""")
def lane_demand(spark, sf_dir):
    return layout.lane_demand(spark_sql(spark, sf_dir, _LANE))


@query("""WITH b AS (SELECT p_size AS rank, max(p_retailprice) AS height FROM part GROUP BY 1) SELECT 'g' AS graph_id, rank, height, round(coalesce(sum(height + 80) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS top FROM b""")
def rank_bands(spark, sf_dir):
    return rounded(layout.rank_bands(spark_sql(spark, sf_dir, "SELECT 'g' AS graph_id, p_size AS rank, p_retailprice AS height FROM {part}")))


_BOXES = "SELECT 'g' AS graph_id, CAST(p_partkey AS STRING) AS id, CAST((p_partkey % 40) * 50 AS DOUBLE) AS x, CAST(IDIV * 30 AS DOUBLE) AS y, CAST(p_size * 2 AS DOUBLE) AS width, 20.0 AS height FROM {part}"
_SPARK_BOXES, _DUCK_BOXES = _BOXES.replace("IDIV", "(p_partkey div 40)").replace("20.0", "CAST(20.0 AS DOUBLE)"), _BOXES.replace("IDIV", "(p_partkey // 40)").replace("{part}", "part").replace("20.0", "20.0::DOUBLE")


@query(f"WITH b AS ({_DUCK_BOXES}) SELECT 'g' AS graph_id, a.id AS a, c.id AS b FROM b a JOIN b c ON a.id < c.id AND a.x < c.x + c.width AND c.x < a.x + a.width AND a.y < c.y + c.height AND c.y < a.y + a.height")
def box_overlaps(spark, sf_dir):
    return collab.overlaps(spark_sql(spark, sf_dir, _SPARK_BOXES))


@query(f"WITH b AS ({_DUCK_BOXES}) SELECT 'g' AS graph_id, a.id AS a, c.id AS b, round(sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2), 4) AS distance, sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) < 30 AS is_critical FROM b a JOIN b c ON a.id < c.id AND sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2) <= 60")
def near_pairs(spark, sf_dir):
    return rounded(collab.near_pairs(spark_sql(spark, sf_dir, _SPARK_BOXES), 60))


@query(f"""WITH b AS ({_DUCK_BOXES}), e AS (SELECT *, min(x) OVER () AS x0, max(x + width) OVER () AS x1, min(y) OVER () AS y0, max(y + height) OVER () AS y1 FROM b),
    c AS (SELECT greatest(0, least(7, floor((x + width / 2 - x0) / greatest(1e-9, x1 - x0) * 8)))::INTEGER AS col, greatest(0, least(5, floor((y + height / 2 - y0) / greatest(1e-9, y1 - y0) * 6)))::INTEGER AS row, count(*) AS boxes FROM e GROUP BY 1, 2)
    SELECT 'g' AS graph_id, col, row, boxes, round(boxes / (max(boxes) OVER ())::DOUBLE, 4) AS density FROM c""")
def density_grid(spark, sf_dir):
    from graphloom.operators.analytics import density_grid as grid

    return rounded(grid(spark_sql(spark, sf_dir, _SPARK_BOXES)))


@query(f"WITH b AS ({_DUCK_BOXES}) SELECT id FROM b WHERE (y >= 0 AND x - 100 >= 0 AND x + y <= 900)")
def in_lasso(spark, sf_dir):
    from graphloom.functions.scalars import in_polygon

    b = spark_sql(spark, sf_dir, _SPARK_BOXES)
    return b.filter(in_polygon(F.col("x"), F.col("y"), [(100.0, 0.0), (900.0, 0.0), (100.0, 800.0)])).select("id")


@query()
def hulls(spark, sf_dir):
    b = spark_sql(spark, sf_dir, _SPARK_BOXES).withColumn("cluster", (F.col("id").cast("long") % 7).cast("string"))
    return layout.convex_hulls(b)


# ---- relational projection and diagrams


@query(f"""{SUPPLY} SELECT graph_id, count(*) AS node_count, (SELECT count(*) FROM edges) AS edge_count FROM nodes GROUP BY 1""")
def relational_graphs(spark, sf_dir):
    return export.relational(graph(spark, sf_dir, "supply"))["graphs"]


@query(f"""{LOYAL} SELECT 'INSERT INTO "edges" ("graph_id", "id", "source", "target", "kind", "label", "condition", "is_cycle") VALUES (''' || graph_id || ''', ''' || id || ''', ''' || source || ''', ''' || target || ''', ''handoff'', NULL, NULL, 0);' AS statement FROM edges""")
def insert_statements(spark, sf_dir):
    return export.inserts(export.relational(graph(spark, sf_dir, "loyal"))["edges"], "edges")


@query(f"""{TYPES} SELECT 'types' AS graph_id, 'flowchart TD' || chr(10) || (SELECT string_agg('  ' || id || '["' || name || '"]', chr(10) ORDER BY ord) FROM nodes) || chr(10) || (SELECT string_agg('  ' || source || ' --> ' || target, chr(10) ORDER BY ord) FROM edges) AS text""")
def mermaid_text(spark, sf_dir):
    return export.mermaid(graph(spark, sf_dir, "transition"))


@query(f"""{TYPES} SELECT 'types' AS graph_id, 'digraph {{' || chr(10) || (SELECT string_agg('  "' || id || '" [label="' || name || '"];', chr(10) ORDER BY ord) FROM nodes) || chr(10) || (SELECT string_agg('  "' || source || '" -> "' || target || '";', chr(10) ORDER BY ord) FROM edges) || chr(10) || '}}' AS text""")
def dot_text(spark, sf_dir):
    return export.dot(graph(spark, sf_dir, "transition"))
