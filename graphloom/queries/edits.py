"""Queries of free-text search, highlights and nested fields, and of the macro actions in sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import macros
from graphloom.plans.search import search
from graphloom.queries.registry import query
from graphloom.queries.rich import R, run
from graphloom.schema import GraphFrames
from graphloom.sources.adapters import ctes, graph

S, SUPPLY = "WITH " + ctes("session"), "WITH " + ctes("supply")


@query(f"""{S} SELECT graph_id, 'node' AS entity, ord, id, 6.0::DOUBLE AS score FROM nodes WHERE model = 'model-1'""")
def search_free_term(spark, sf_dir):
    """A bare term, which all text fields are searched for, in nodes and edges."""
    return search(graph(spark, sf_dir, "session"), "model-1")


@query(f"""{S} SELECT graph_id, id, 'name' AS field, 0::INTEGER AS "start", 5::INTEGER AS "end", 'click' AS text FROM nodes WHERE kind = 'click'
    UNION ALL SELECT graph_id, id, 'id', length(id)::INTEGER - 2, length(id)::INTEGER, right(id, 2) FROM nodes WHERE kind = 'click' AND id LIKE '%42'""")
def search_highlights(spark, sf_dir):
    """Where names and ids match."""
    found = search(graph(spark, sf_dir, "session"), "name:click OR (id:/42$/ AND name:click)", edges=False, highlights=True)
    return found.select("graph_id", "id", F.explode("highlights").alias("h")).select("graph_id", "id", "h.*").distinct()


@query(f"""{R} SELECT graph_id, 'node' AS entity, ord, id, 10.0::DOUBLE AS score FROM n WHERE k % 2 = 0 AND k % 3 = 1""")
def search_nested(spark, sf_dir):
    """A field that only the open parts of nodes have."""
    return search(run(spark, sf_dir), "odd=1", edges=False)


@query(f"""{S} SELECT graph_id, 'node' AS entity, ord, id, 1.0::DOUBLE AS score FROM nodes UNION ALL SELECT graph_id, 'edge', ord, id, 1.0 FROM edges""")
def search_everything(spark, sf_dir):
    """An empty query."""
    return search(graph(spark, sf_dir, "session"), "  ")


@query(f"""{S}, m AS (SELECT graph_id, ord, id, kind, CASE WHEN status = 'error' THEN 10.0 ELSE 5.0 END AS score FROM nodes WHERE status = 'error' OR NOT (kind = 'view')),
    r AS (SELECT graph_id, id, score, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, ord) AS place FROM m) SELECT graph_id, id, score::DOUBLE AS score, place FROM r""")
def search_order(spark, sf_dir):
    """Matches in order of their scores, then of the input."""
    from pyspark.sql import Window

    found = search(graph(spark, sf_dir, "session"), "tier=none OR kind=error OR NOT kind=view", edges=False)
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("score"), "ord"))
    return found.select("graph_id", "id", F.when(F.col("score") > 5, 10.0).otherwise(5.0).alias("score"), place.cast("long").alias("place"))


#: One action of each kind, on nodes of the supply graph; ``{edge}`` is the edge that leads to the tenth nation.
ACTIONS = [
    ("create_node", {"id": "x1", "kind": "tool", "status": "pending"}), ("create_node", {"id": "n3", "name": "new three", "kind": "gate"}), ("update_node", {"id": "r1", "description": "changed"}),
    ("set_status", {"id": "n0", "status": "error"}), ("set_kind", {"id": "n1", "kind": "critic"}), ("set_section", {"id": "n2", "section_id": "z"}), ("rename_node", {"id": "r0", "name": "zero"}),
    ("duplicate_node", {"id": "n4", "new_id": "n4b"}), ("merge_metrics", {"id": "n5", "cost_usd": 5, "retries": 2}), ("add_badge", {"id": "n6", "label": "b"}), ("delete_node", {"id": "n7"}),
    ("create_edge", {"source": "x1", "target": "n0"}), ("create_edge", {"source": "x1", "target": "n1", "id": "own"}), ("retarget_edge", {"id": "own", "target": "n2"}), ("update_edge", {"id": "own", "label": "named"}),
    ("clear_edges", {"id": "n8"}), ("reverse_edge", {"id": "{edge}"}), ("delete_edge", {"source": "x1", "target": "n0"}),
]


@query(f"""{SUPPLY}, tenth AS (SELECT 'r' || n_regionkey || '->n10' AS id FROM nation WHERE n_nationkey = 10),
    v AS (SELECT id, name, kind, status, section_id, NULL::VARCHAR AS description, cost_usd, retries FROM nodes WHERE id NOT IN ('n3', 'n7')
        UNION ALL SELECT 'x1', 'x1', 'tool', 'pending', NULL, NULL, NULL, NULL UNION ALL SELECT 'n3', 'new three', 'gate', NULL, NULL, NULL, NULL, NULL
        UNION ALL SELECT 'n4b', name, kind, status, section_id, NULL, cost_usd, retries FROM nodes WHERE id = 'n4'),
    w AS (SELECT id, CASE id WHEN 'r0' THEN 'zero' ELSE name END AS name, CASE id WHEN 'n1' THEN 'critic' ELSE kind END AS kind, CASE id WHEN 'n0' THEN 'error' ELSE status END AS status,
        CASE id WHEN 'n2' THEN 'z' ELSE section_id END AS section_id, CASE id WHEN 'r1' THEN 'changed' END AS description, CASE id WHEN 'n5' THEN 5.0 ELSE cost_usd END::DOUBLE AS cost_usd, CASE id WHEN 'n5' THEN 2.0 ELSE retries END::DOUBLE AS retries, CASE id WHEN 'n6' THEN 'b' END AS badge FROM v),
    e AS (SELECT CASE WHEN id = (SELECT id FROM tenth) THEN target ELSE source END AS source, CASE WHEN id = (SELECT id FROM tenth) THEN source ELSE target END AS target, '' AS label FROM edges WHERE source NOT IN ('n7', 'n8') AND target NOT IN ('n7', 'n8')
        UNION ALL SELECT 'x1', 'n2', 'named')
    SELECT w.*, (SELECT count(*) FROM e WHERE source = w.id) AS ways_out, (SELECT count(*) FROM e WHERE target = w.id) AS ways_in, (SELECT max(label) FROM e WHERE target = w.id AND label <> '') AS label FROM w""")
def macro_actions(spark, sf_dir):
    """All nodes with their edges' numbers after one action of each kind, run as a macro."""
    region = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey = 10").select("n_regionkey").first()
    edge = f"r{region[0]}->n10" if region else "none"
    steps = [{"action": name, **{k: v.replace("{edge}", edge) if isinstance(v, str) else v for k, v in a.items()}} for name, a in ACTIONS]
    g = macros.Macro("all", {}, steps).run(graph(spark, sf_dir, "supply"), "supply")
    return _edited(g)


def _edited(g: GraphFrames):
    of = lambda end, name: g.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name), *([F.max(F.nullif("label", F.lit(""))).alias("label")] if end == "target" else []))
    n = g.nodes.select("id", "name", "kind", "status", "section_id", "description", F.col("metrics.cost_usd").alias("cost_usd"), F.col("metrics.retries").alias("retries"), F.get("badges", F.lit(0))["label"].alias("badge"))
    return n.join(of("source", "ways_out"), "id", "left").join(of("target", "ways_in"), "id", "left").fillna(0, ["ways_out", "ways_in"])
