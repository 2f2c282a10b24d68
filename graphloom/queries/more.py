"""Queries of lenses, filters, macros, links, traces, layout tables and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import drawing, layout, lenses, macros, replay, textops, traverse
from graphloom.queries.logs import _names
from graphloom.queries.registry import query, rounded
from graphloom.sources import export, graph_json
from graphloom.sources.adapters import ctes, duck, duck_functions, graph, spark_functions, spark_sql
from graphloom.streaming import healing, telemetry

S, L, P = "WITH " + ctes("session"), "WITH " + ctes("loyal"), "WITH " + ctes("supply")


@query(f"""{S}, v AS (SELECT graph_id, id, tokens_in + tokens_out AS value FROM nodes), b AS (SELECT *, min(value) OVER g AS lo, max(value) OVER g AS hi FROM v WINDOW g AS (PARTITION BY graph_id)),
    l AS (SELECT *, CASE WHEN hi - lo <= 0 THEN 0.5 ELSE sqrt(value - lo) / sqrt(hi - lo) END AS level FROM b) SELECT graph_id, id, value, round(level, 4) AS level, level >= 0.5 AS is_shown FROM l""")
def lens_tokens(spark, sf_dir):
    return rounded(lenses.evaluate(graph(spark, sf_dir, "session"), "tokens", "sqrt", 0.5).drop("colour"))


_HEX = "lpad(lower(to_hex(floor({0} + 0.5)::BIGINT)), 2, '0')"
_STOP = "([{0}]::DOUBLE[])[low + {1}]"


def _mixed(*stops: int) -> str:
    table = ", ".join(map(str, stops))
    return _HEX.format(f"({_STOP.format(table, 1)} + ({_STOP.format(table, 2)} - {_STOP.format(table, 1)}) * (at_ - low))")


@query(f"""{S}, v AS (SELECT graph_id, id, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END AS value FROM nodes), q AS (SELECT *, min(value) OVER g AS lo, max(value) OVER g AS hi, cume_dist() OVER (PARTITION BY graph_id ORDER BY value) AS q FROM v WINDOW g AS (PARTITION BY graph_id)),
    l AS (SELECT *, CASE WHEN hi - lo <= 0 THEN 0.5 ELSE q END AS level FROM q), a AS (SELECT *, level * 4 AS at_, least(floor(level * 4), 3)::BIGINT AS low FROM l)
    SELECT graph_id, id, value, round(level, 4) AS level, level >= 0 AS is_shown, '#' || {_mixed(44, 171, 255, 253, 215)} || {_mixed(123, 217, 255, 174, 25)} || {_mixed(182, 233, 191, 97, 28)} AS colour FROM a""")
def lens_colours(spark, sf_dir):
    return rounded(lenses.evaluate(graph(spark, sf_dir, "session"), "heatmap", "quantile"))


@query()
def lens_critical(spark, sf_dir):
    return lenses.evaluate(graph(spark, sf_dir, "conversation"), "critical")


@query(f"""{S} SELECT graph_id, count(*) AS all_, count(*) FILTER (status IN ('error', 'warning')) AS errors, count(*) FILTER (status IN ('success', 'cached')) AS success, count(*) FILTER (kind = 'tool') AS tools FROM nodes GROUP BY 1""")
def quick_filters(spark, sf_dir):
    n = graph(spark, sf_dir, "session").nodes
    return n.groupBy("graph_id").agg(*[F.count_if(lenses.quick_filter(f)).alias(a) for f, a in (("all", "all_"), ("errors", "errors"), ("success", "success"), ("tools", "tools"))])


@query(f"""{L}, live AS (SELECT graph_id, kind, arg_min(id, ord) AS fallback FROM nodes WHERE status NOT IN ('error', 'skipped') GROUP BY 1, 2) SELECT n.graph_id, n.id, fallback FROM nodes n LEFT JOIN live USING (graph_id, kind) WHERE status = 'error'""")
def fallback_routes(spark, sf_dir):
    g = graph(spark, sf_dir, "loyal")
    return traverse.fallback_routes(g, g.nodes.filter("status = 'error'").select("graph_id", "id"))


@query(f"""{P} SELECT (SELECT count(*) FROM nodes WHERE id <> 'n1') AS nodes, (SELECT count(*) FROM edges WHERE source <> 'n1' AND target <> 'n1') AS edges""")
def macro_delete_node(spark, sf_dir):
    g = macros.apply(graph(spark, sf_dir, "supply"), "delete_node", "supply", id="n1")
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).join(g.edges.agg(F.count(F.lit(1)).alias("edges")))


@query(f"""{P} SELECT kind, CASE WHEN kind = 'task' AND status = 'pending' THEN 'skipped' ELSE status END AS status, count(*) AS nodes FROM nodes GROUP BY 1, 2""")
def macro_batch(spark, sf_dir):
    g = macros.batch_update(graph(spark, sf_dir, "supply"), (F.col("kind") == "task") & (F.col("status") == "pending"), status="skipped")
    return g.nodes.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""{P}, r AS (SELECT e.id AS edge_id, least(a.step, b.step)::INTEGER AS lo, greatest(a.step, b.step)::INTEGER AS hi FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target)
    SELECT 'supply' AS graph_id, edge_id, unnest(range(lo + 1, hi))::INTEGER AS rank FROM r WHERE hi - lo > 1""")
def layer_dummies(spark, sf_dir):
    g = graph(spark, sf_dir, "supply")
    return layout.dummies(g.nodes.select("graph_id", "id", F.col("step").cast("int").alias("rank")), g.edges)


@query(f"""{P}, n AS (SELECT graph_id, id, name, kind, status, step, section_id, model, tier FROM nodes) SELECT * FROM n""")
def relational_nodes(spark, sf_dir):
    return export.relational(graph(spark, sf_dir, "supply"))["nodes"]


@query(f"""{S} SELECT graph_id, id AS node_id, duration_ms, tokens_in + tokens_out AS tokens, cost_usd, retries FROM nodes""")
def relational_metrics(spark, sf_dir):
    return export.relational(graph(spark, sf_dir, "session"))["node_metrics"]


@query(f"""{L} SELECT n.graph_id, count(*) AS nodes, coalesce(any_value(e.k), 0) AS edges FROM nodes n LEFT JOIN (SELECT graph_id, count(*) AS k FROM edges GROUP BY 1) e USING (graph_id) GROUP BY 1""")
def document_round_trip(spark, sf_dir):
    """Graphs written as JSON documents and read again, all nodes and edges."""
    g, _ = graph_json.read_documents(export.documents(graph(spark, sf_dir, "loyal")))
    n = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")), "graph_id", "left").fillna(0, ["edges"])


_DOCS = """SELECT CAST(user_id AS STRING) AS graph_id, '{{{{"nodes": [' || array_join(collect_list('{{{{"id": "' || (event_id % 50) || '", "name": ' || event_id || '}}}}'), ', ') || '], "edges": []}}}}' AS text FROM {events} GROUP BY user_id""".replace("{{{{", "{{").replace("}}}}", "}}")


@query("""WITH c AS (SELECT user_id, count(*) AS all_, count(DISTINCT event_id % 50) AS ids FROM events GROUP BY 1) SELECT CAST(user_id AS STRING) AS graph_id, 'DUPLICATE_ID' AS code, all_ - ids AS warnings FROM c WHERE all_ > ids
    UNION ALL SELECT CAST(user_id AS STRING), 'WRONG_TYPE', ids FROM c""")
def document_warnings(spark, sf_dir):
    _, w = graph_json.read_documents(spark_sql(spark, sf_dir, _DOCS))
    return w.groupBy("graph_id", "code").agg(F.count(F.lit(1)).alias("warnings"))


_PINGS = "SELECT CAST(user_id AS STRING) AS link, event_id AS seq, CASE WHEN event_type <> 'error' THEN value END AS rtt FROM {events}"


@query(f"""WITH p AS ({duck(_PINGS)}) SELECT link, seq, round(avg(rtt) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS avg_rtt,
    sum(CASE WHEN rtt IS NULL THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS is_unhealthy FROM p WINDOW w AS (PARTITION BY link ORDER BY seq)""")
def link_round_trips(spark, sf_dir):
    return rounded(healing.round_trips(spark_sql(spark, sf_dir, _PINGS)).drop("rtt"), 6)


@query("""WITH RECURSIVE i AS (SELECT event_id AS id, user_id AS key, event_type AS type, event_id * 1000 AS ts FROM events WHERE event_type IN ('error', 'click')), p(name, type, priority, cooldown_ms) AS (VALUES ('restart', 'error', 5, 60000), ('page', 'error', 1, 0), ('log', 'click', 1, 500000)),
    j AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority DESC, name) AS nth FROM i JOIN p USING (type)), k AS (SELECT id, key, name, ts, cooldown_ms FROM j WHERE nth = 1),
    r(key, name, ts) AS (SELECT key, name, min(ts) FROM k GROUP BY 1, 2 UNION SELECT r.key, r.name, min(k.ts) FROM r JOIN k ON k.key = r.key AND k.name = r.name AND k.ts > r.ts AND k.ts >= r.ts + k.cooldown_ms GROUP BY r.key, r.name)
    SELECT k.id, k.key, k.name, r.ts IS NOT NULL AS runs FROM k LEFT JOIN r ON r.key = k.key AND r.name = k.name AND r.ts = k.ts""")
def playbook_runs(spark, sf_dir):
    i = spark_sql(spark, sf_dir, "SELECT event_id AS id, user_id AS key, event_type AS type, 'error' AS severity, event_id * 1000 AS ts FROM {events} WHERE event_type IN ('error', 'click')")
    p = spark.createDataFrame([("restart", "error", "error", 60_000, 5), ("page", "error", "warning", 0, 1), ("log", "click", "info", 500_000, 1)], "name string, type string, min_severity string, cooldown_ms long, priority int")
    return healing.playbook_runs(i, p).select("id", "key", "name", "runs")


def _chunks(d) -> str:
    base = d["ms"]("TIMESTAMP '2020-01-01 00:00:00'", "ts")
    return f"SELECT CAST(user_id AS STRING) AS session_id, {base} AS ts, event_id AS ord, CAST(event_id % 100 AS DOUBLE) AS bytes FROM {{events}}"


_CHUNKS_SPARK = _chunks(spark_functions()).replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace(", ts)", ", CAST(ts AS TIMESTAMP_NTZ))")


@query(f"""WITH c AS ({duck(_chunks(duck_functions()))}), g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, ord) AS gap FROM c)
    SELECT session_id, min(ts) AS first_ms, round(avg(gap), 3) AS avg_gap_ms, max(gap) AS max_gap_ms, sum(bytes) AS bytes, max(ts) - min(ts) AS span_ms, round(CASE WHEN max(ts) > min(ts) THEN sum(bytes) / ((max(ts) - min(ts)) / 1000) ELSE 0 END, 3) AS bytes_per_second FROM g GROUP BY 1""")
def trace_timing(spark, sf_dir):
    return rounded(replay.trace_timing(spark_sql(spark, sf_dir, _CHUNKS_SPARK)), 3)


@query("""WITH m AS (SELECT 'm' || (event_id % 9) AS name, value, event_id AS arrival FROM events WHERE event_type = 'purchase'), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY arrival DESC) AS nth FROM m) SELECT name, value, arrival FROM r WHERE nth <= 50""")
def metric_history(spark, sf_dir):
    p = spark_sql(spark, sf_dir, "SELECT 'metric' AS type, to_json(named_struct('name', 'm' || (event_id % 9), 'value', value)) AS payload, event_id AS arrival FROM {events} WHERE event_type = 'purchase'")
    return telemetry.metric_history(p, 50).drop("nth")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_name AS line FROM part) SELECT ord, line FROM l WHERE ord < 10""")
def text_head(spark, sf_dir):
    return textops.head(_names(spark, sf_dir))


@query(f"""WITH RECURSIVE {ctes("relay")}, w AS (SELECT graph_id, source AS a, target AS b FROM edges UNION SELECT graph_id, target, source FROM edges), r(graph_id, id, far) AS (SELECT graph_id, id, id FROM nodes UNION SELECT r.graph_id, r.id, w.b FROM r JOIN w ON w.graph_id = r.graph_id AND w.a = r.far),
    c AS (SELECT graph_id, component, ceil(sqrt(count(*))) * 160.0 AS width, ceil(sqrt(count(*))) * 140.0 AS height FROM (SELECT graph_id, id, min(far) AS component FROM r GROUP BY 1, 2) GROUP BY 1, 2),
    e AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY height DESC, component) - 1 AS nth, greatest(1, floor(1200 / (max(width) OVER (PARTITION BY graph_id) + 60))) AS per FROM c), f AS (SELECT *, floor(nth / per) AS shelf FROM e),
    t AS (SELECT graph_id, shelf, sum(max(height) + 60) OVER (PARTITION BY graph_id ORDER BY shelf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dy FROM f GROUP BY 1, 2)
    SELECT f.graph_id, component, coalesce(sum(width + 60) OVER (PARTITION BY f.graph_id, f.shelf ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS dx, coalesce(dy, 0)::DOUBLE AS dy FROM f JOIN t ON t.graph_id = f.graph_id AND t.shelf = f.shelf""")
def component_packing(spark, sf_dir):
    """Shelf offsets of the weak components of the acyclic customer graphs, sized by their nodes."""
    c = traverse.components(graph(spark, sf_dir, "relay")).groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n"))
    return layout.pack_components(c.select("graph_id", "component", (F.ceil(F.sqrt("n")) * 160.0).alias("width"), (F.ceil(F.sqrt("n")) * 140.0).alias("height")), width=1200)


@query()
def route_crossings(spark, sf_dir):
    return layout.geometric_crossings(drawing.routes(graph(spark, sf_dir, "transition")))
