"""Edge cases of graph, diff, replay, macro, text and streaming operators."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import anomaly, diff, drawing, layout, macros, paths, replay, spans, textops, traverse
from graphloom.schema import GraphFrames
from graphloom.sources.graph_json import read_documents
from graphloom.streaming import healing, telemetry
from tests import folded


def make(spark, nodes, edges, graph_id="g"):
    doc = {"nodes": [{"id": n} if isinstance(n, str) else n for n in nodes], "edges": [dict(zip(("source", "target", "isCycle"), e)) if isinstance(e, tuple) else e for e in edges]}
    return read_documents(spark.createDataFrame([(graph_id, json.dumps(doc))], "graph_id string, text string"))[0]


def node(id_, ms=None, **more):
    return {"id": id_, "metrics": {"durationMs": ms}, **more}


def test_empty_graphs(spark):
    g = GraphFrames.empty(spark)
    for df in (traverse.components(g), traverse.blast_radius(g), paths.strong_components(g), anomaly.detect(g), drawing.layered_layout(g), traverse.longest_paths(g)):
        assert df.count() == 0


def test_critical_paths_differ_in_ties(spark):
    g = make(spark, [node("a", 5), node("b", 5), node("c", 0)], [("a", "c"), ("b", "c")])
    first = [r.id for r in paths.critical_path(g, "anomaly").orderBy("position").collect()]
    last = [r.id for r in paths.critical_path(g, "analytics").orderBy("position").collect()]
    assert first == ["a"] and last == ["b", "c"]


def test_cycles_and_components(spark):
    g = make(spark, "abcde", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")])
    scc = {r.id: (r.component, r.size, r.is_cyclic) for r in paths.strong_components(g).collect()}
    assert scc["a"] == scc["b"] == scc["c"] == ("a", 3, True) and scc["d"] == ("d", 1, True) and scc["e"] == ("e", 1, False)
    assert sorted(len(r.ids) for r in paths.cycles(g).collect()) == [1, 3]
    assert {r.id: r.component for r in traverse.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert paths.feedback_edges(g).filter("is_feedback").count() == 1
    assert paths.topological_order(g).filter("is_residual").count() == 4


def test_closure_quirk(spark):
    g = make(spark, "abc", [("a", "b"), ("b", "c")])
    root = g.nodes.filter("id = 'a'").select("graph_id", "id")
    ids = lambda **o: sorted(r.id for r in traverse.closure(g, root, **o).collect())
    assert ids(include_roots=False) == ["b", "c"] and ids(max_depth=1, include_roots=False) == ["a", "b"] and ids(direction="up") == ["a"]


def test_random_ranks_orders_crossings(spark):
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(2, 12)
        nodes = [{"id": str(i), "chars": 3} for i in range(n)]
        edges = [{"id": f"{i}", "source": str(rng.randrange(n)), "target": str(rng.randrange(n)), "is_cycle": False, "weight": 1.0, "min_len": 1} for i in range(rng.randint(1, 25))]
        ids, arcs = [x["id"] for x in nodes], layout.acyclic(nodes, edges)
        a, b = layout.longest_path_ranks(ids, arcs), layout.tight_ranks(ids, arcs)
        assert all(b[y] - b[x] >= k and a[y] - a[x] >= k for x, y, _, k in arcs)
        assert sum(w * (b[y] - b[x]) for x, y, w, _ in arcs) <= sum(w * (a[y] - a[x]) for x, y, w, _ in arcs)
        up, low = [f"u{i}" for i in range(n)], [f"v{i}" for i in range(n)]
        seg = [(f"u{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(20)]
        brute = sum((int(p[0][1:]) - int(q[0][1:])) * (int(p[1][1:]) - int(q[1][1:])) < 0 for p, q in itertools.combinations(seg, 2))
        assert layout.count_crossings(up, low, seg) == brute


def test_layout_keeps_boxes_apart(spark):
    g = make(spark, [f"n{i}" for i in range(12)], [("n0", f"n{i}") for i in range(1, 11)] + [("n3", "n11"), ("n11", "n0"), ("n4", "n4")])
    placed, ways = drawing.layered_layout(g), drawing.routes(g)
    bad = layout.constraint_scan(placed, ways).first()
    assert (bad.box_overlaps, bad.routes_through_boxes) == (0, 0) and placed.count() == 12 and ways.count() == 13
    wide = layout.oriented(placed, "LR").agg(F.max("x")).first()[0]
    assert wide == placed.agg(F.max("y")).first()[0]
    a, b = layout.force_layout(g).orderBy("id").collect(), layout.force_layout(g).orderBy("id").collect()
    assert a == b


def test_anomalies_and_fixes(spark):
    g = make(spark, [node("a", 100, status="error", metrics={"retries": 7}), node("b"), node("c"), node("d", status="pending")], [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    found = anomaly.detect(g)
    kinds = {r.type: r.severity for r in found.collect()}
    assert kinds["runaway_retry_loop"] == "critical" and kinds["error_cascade"] == "critical" and kinds["diamond_join_deadlock"] == "critical"
    assert anomaly.health(g, found).first().health == 0
    fixed = anomaly.quick_fix(g, "reset_retries", "g", "a")
    assert "runaway_retry_loop" not in {r.type for r in anomaly.detect(fixed, rules=(anomaly.retry_loops,)).collect()}
    assert anomaly.quick_fix(g, "break_cycle", "g", "edge-0").edges.count() == 3
    assert "critical" in anomaly.summary_text(found) and anomaly.about(found, node="a").count() > 0


def test_finding_status(spark):
    f = lambda i, s: {"id": i, "status": s}
    base = make(spark, [{"id": "n", "metadata": {"findings": [f("1", "open"), f("2", "resolved"), f("3", "resolved"), f("4", "open")]}}], [])
    comp = make(spark, [{"id": "n", "metadata": {"findings": [f("1", "resolved"), f("2", "open"), f("5", "open"), f("4", "open")]}}], [])
    by = lambda **o: {r.finding: r.status for r in diff.finding_diff(base, comp, **o).collect()}
    assert by() == {"1": "repaired", "2": "regressed", "3": "repaired", "4": "persistent_open", "5": "new"}
    assert by(by_node=False)["3"] == "persistent_resolved"
    n, e = diff.node_diff(base, comp), diff.edge_diff(base, comp)
    assert n.first().status == "unchanged" and diff.rollup(n, e).first().unchanged == 1


def test_spans_orphans_and_cycles(spark):
    rows = [("g", i, *r) for i, r in enumerate([("a", None, 0.0, 10.0), ("b", "a", 2.0, 5.0), ("c", "gone", 10.0, 12.0), ("x", "y", 20.0, 20.0), ("y", "x", 21.0, 19.0)])]
    s = spark.createDataFrame(rows, "graph_id string, ord long, id string, parent_id string, start_ms double, end_ms double").selectExpr("*", "'n' as name", "'a' as agent_id", "'?' as tier", "'?' as status", "'?' as category", "1D as tokens", "cast(null as double) as cost_usd")
    got = {r.id: (r.depth, r.self_ms, r.tier) for r in spans.tree(s).collect()}
    assert got["a"] == (0, 7.0, "subagent") and got["b"] == (1, 3.0, "subagent") and got["c"][0] == 0 and got["x"][0] == 0 and got["y"][0] == 1
    assert spans.active_time(s).first().active_ms == 12.0 and spans.peak_concurrency(s).first().peak == 2


def test_replay_fold_verbs():
    e = lambda k, t=None, **p: {"kind": k, "payload": json.dumps({"task_id": t, **p} if t else p), "actor": "me"}
    s = folded.fold([e("task-added", "t"), e("task:reject", "u"), e("task-claimed", "t"), e("task-rejected", "t")])
    assert s["tasks"] == {"t": "error"} and s["failed"] == {"t", "u"} and s["leases"] == {"t": "me"}
    s = folded.fold([e("task-claimed", "t"), e("review-recorded", "t", passed=False), e("task-finished", "t"), {"kind": "plan-compiled", "payload": "{}", "projection": json.dumps({"graph": {"nodes": [{"id": "n"}], "edges": [{"source": "n", "target": "t"}]}})}, e("task-removed", "t")])
    assert s["tasks"] == {} and list(s["nodes"]) == ["n"] and s["edges"] == {} and s["leases"] == {}


def test_macros(spark):
    g = make(spark, "ab", [("a", "b")])
    ed = macros.Editor([g])
    ed.run("create_node", "g", id="c", kind="tool")
    ed.run("create_edge", "g", source="b", target="c")
    ed.run("delete_node", "g", id="b")
    now = ed.versions[ed.at]
    assert sorted(r.id for r in now.nodes.collect()) == ["a", "c"] and now.edges.count() == 0
    assert ed.undo().edges.count() == 2 and ed.redo().edges.count() == 0 and ed.jump(0).nodes.count() == 2
    assert macros.substitute("{{ x | upper }} ${y || 'd'} $index", {"x": "k"}, index=3) == "K d 3"
    assert macros.check_parameters({"n": {"type": "number", "max": 3}, "m": {"required": True}}, {"n": 5}) == ["n is out of range", "m is missing"]


def test_stored_macros(spark):
    g = make(spark, "ab", [("a", "b")])
    m = macros.Macro("Add", {"who": {"required": True}}, [{"action": "create_node", "id": "{{who | lower}}"}, {"action": "create_edge", "source": "b", "target": "{{who | lower}}"}])
    again = macros.Macro.from_json(m.to_json())
    out = again.run(g, "g", {"who": "C"})
    assert again == m and sorted(r.id for r in out.nodes.collect()) == ["a", "b", "c"] and out.edges.filter("id = 'b->c'").count() == 1
    with pytest.raises(ValueError, match="missing"):
        m.run(g, "g")
    with pytest.raises(ValueError, match="not a macro"):
        macros.Macro.from_json("{}")
    assert macros.Registry([m]).find("ad") == [m]


def test_shell(spark):
    lines = spark.createDataFrame(list(enumerate(["b 2", "a 1", "a 1", "c", "a 1"])), "ord long, line string")
    out = lambda c, **v: [r.line for r in textops.shell(c, {"f": lines}, v).orderBy("ord").collect()]
    assert out("cat f | grep -v c | sort -u") == ["a 1", "b 2"]
    assert out("uniq -c f")[1].split() == ["2", "a", "1"] and out("uniq -u f") == ["b 2", "c", "a 1"]
    assert out("nothing f || head -n 1 f") == ["b 2"] and out("wc -l f > g; cat g") == ["5"] and out("grep $W f", W="c") == ["c"]


def test_breaker_and_first_sights(spark):
    calls = [("k", i, float(t), ok) for i, (t, ok) in enumerate([(0, False)] * 5 + [(1, True), (11_000, True), (11_001, True)])]
    rows = healing.circuit_breakers(spark.createDataFrame(calls, "key string, ord long, ts double, ok boolean")).orderBy("ord").collect()
    assert [r.state for r in rows] == ["CLOSED"] * 4 + ["OPEN", "OPEN", "HALF_OPEN", "CLOSED"] and rows[5].refused
    p = spark.createDataFrame([("x", t, t) for t in (0, 30, 61, 90, 125)], "id string, t long, arrival long").selectExpr("id", "'log' as type", "timestamp_seconds(t) as ts", "t as sequence", "'s' as source", "'n' as node_id", "'a' as agent_id", "'low' as priority", "'' as topic", "'{}' as payload", "arrival")
    assert [r.arrival for r in telemetry.first_sights(p, 60_000).orderBy("arrival").collect()] == [0, 61, 125]


def test_streams(spark, tmp_path):
    rows = [{"id": f"p{i % 6}", "type": "node_status", "ts": f"2024-01-01T00:00:{i:02d}Z", "node_id": f"n{i % 2}", "payload": json.dumps({"status": "ok" if i < 8 else "bad"}), "arrival": i} for i in range(10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    source = telemetry.read_stream(spark, str(tmp_path / "in"))
    for name, df, mode in (("once", telemetry.deduplicated(source), "append"), ("last", telemetry.node_status(source), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("once").count() == 6
    assert {r.node_id: r.status for r in spark.table("last").collect()} == {"n0": "bad", "n1": "bad"}
    seen = []
    q = telemetry.route(source, {"n0": (F.col("node_id") == "n0", lambda b, k: seen.append(b.count()))}, str(tmp_path / "r"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 5


@pytest.mark.parametrize(("q", "t", "want"), [
    ("abc", "abc", 1097), (" ABC ", "  abc ", 1097), ("ab", "abc", 798), ("wo", "hello world", 624), ("hw", "hello world", 591), ("rv", "resetViewport", 589),
    ("hlo", "hello", 100 + 35 - 2 - 2 + 95), ("elo", "hello", 100 - 3 - 2 + 20 + 95), ("abc", "xaxbxc" + "x" * 200, 100 - 3 - 2 - 2), ("a", "b" * 300 + "a", 60), ("zz", "hello", 0), ("a.c", "abc", 0), ("", "x", 0), ("x", "", 0), ("x", None, None),
])
def test_fuzzy(spark, q, t, want):
    d = spark.createDataFrame([(t,)], "t string")
    assert d.select(scalars.fuzzy_score(q, F.col("t"))).first()[0] == want


def test_fuzzy_search(spark):
    d = spark.createDataFrame([("Reset view", None, None), ("Zoom", "reset all", ["x"]), ("Pan", None, ["reset"]), ("Other", "none", [])], "title string, description string, keywords array<string>")
    got = [(r.title, r.score) for r in scalars.fuzzy_search(d, "reset").collect()]
    assert got == [("Pan", math.floor((1000 + 95) * 0.85)), ("Reset view", 790), ("Zoom", math.floor(792 * 0.7))]
    assert scalars.fuzzy_search(d, " ").count() == 4


def test_retry_loops_count_rejections(spark):
    """Events that are rejected, or are rejections or repairs, count as retries and as repair rounds."""
    from graphloom.operators import anomaly
    from graphloom.schema import GraphFrames

    ev = lambda kind, status, n: [{"type": kind, "status": status}] * n
    rows = [("g", "a", ev("note", "rejected", 6)), ("g", "b", ev("repair", "ok", 6)), ("g", "c", ev("rejection", None, 1)), ("g", "d", ev("note", "ok", 9)), ("g", "e", ev(None, None, 2))]
    nodes = spark.createDataFrame(rows, "graph_id string, id string, provenance array<struct<type:string,status:string>>")
    edges = spark.createDataFrame([], "graph_id string, id string, source string, target string")
    out = {r.node_ids[0]: (r.severity, r.value) for r in anomaly.retry_loops(GraphFrames.of(nodes, edges), anomaly.Limits()).collect()}
    assert out == {"a": ("critical", 12), "b": ("critical", 12), "c": ("warning", 1)}


def test_scalars(spark):
    df = spark.createDataFrame([(-2.5, "12abc", "Rate LIMIT hit")], "x double, s string, m string")
    r = df.select(scalars.js_round(F.col("x")).alias("r"), scalars.leading_number(F.col("s")).alias("n"), scalars.error_class(F.col("m")).alias("c"), scalars.format_duration(F.lit(61_000.0)).alias("d"), scalars.in_polygon(F.lit(1.0), F.lit(0.0), [(0, 0), (2, 0), (0, 2)]).alias("p")).first()
    assert (r.r, r.n, r.c, r.d, r.p) == (-2, 12.0, "rate_limit_quota", "1m 1s", True)
    assert scalars.convex_hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert [d["op"] for d in scalars.line_diff("a\nb", "a\nc")] == ["same", "delete", "insert"]


def test_playbooks_cool_down_from_their_last_run(spark):
    """Incidents that come faster than the cooldown: every third runs; one after a pause runs; a condition keeps one out."""
    r = random.Random(3)
    rows, t = [], 0
    for i in range(200):
        t += r.choice([10, 40, 40, 40, 200])
        rows.append((i, i % 2, "error", "error", t))
    incidents = spark.createDataFrame(rows, "id long, key long, type string, severity string, ts long")
    books = spark.createDataFrame([("restart", "error", "error", 100, 5), ("page", "error", "info", 0, 1)], "name string, type string, min_severity string, cooldown_ms long, priority int")
    got = {x.id: (x.name, x.runs) for x in healing.playbook_runs(incidents, books).collect()}
    want, last = {}, {}
    for i, k, _, _, ts in rows:
        runs = k not in last or ts - last[k] >= 100
        last[k] = ts if runs else last[k]
        want[i] = ("restart", runs)
    assert got == want and 0 < sum(x for _, x in want.values()) < 200
    only = healing.playbook_runs(incidents, books, {"restart": F.col("id") % 2 == 0})
    assert {x.id: x.name for x in only.collect()} == {i: "restart" if i % 2 == 0 else "page" for i in range(200)}


def test_optimal_ranks_against_brute_force():
    """Small random graphs: the least weighted sum of spans, tried out; balancing keeps it, a limit holds."""
    r = random.Random(17)
    for _ in range(60):
        n = r.randint(2, 6)
        ids = [f"v{i}" for i in range(n)]
        arcs = [(ids[i], ids[j], float(r.randint(1, 4)), r.choice([1, 1, 2])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda rank: sum(w * (rank[b] - rank[a]) for a, b, w, _ in arcs)  # noqa: B023, E731
        fits = lambda rank: all(rank[b] - rank[a] >= k for a, b, _, k in arcs)  # noqa: B023, E731
        best = min((cost(dict(zip(ids, c))) for c in itertools.product(range(7), repeat=n) if fits(dict(zip(ids, c)))), default=0) if n < 6 else None
        rank = layout.optimal_ranks(ids, arcs)
        assert fits(rank) and (best is None or cost(rank) == best) and cost(rank) <= cost(layout.tight_ranks(ids, arcs)) <= cost(layout.longest_path_ranks(ids, arcs))
        even = layout.balanced_ranks(ids, arcs)
        assert fits(even) and cost(even) == cost(rank)
        few = layout.balanced_ranks(ids, arcs, 1)
        assert fits(few) and len(set(few.values())) == n


def test_gates_find_what_is_wrong(spark):
    g = make(spark, ["a", "b", "c", "d"], [("a", "b"), ("c", "d"), ("a", "d")])
    ids = {(r.source, r.target): r.id for r in g.edges.collect()}
    box = lambda i, x, y, w=100.0: ("g", i, float(x), float(y), w, 50.0)
    fine = [box("a", 0, 0), box("b", 0, 200), box("c", 200, 0), box("d", 200, 200)]
    path = lambda e, *p: ("g", ids[e], [float(x) for x, _ in p], [float(y) for _, y in p])
    straight = [path(("a", "b"), (50, 50), (50, 200)), path(("c", "d"), (250, 50), (250, 200)), path(("a", "d"), (90, 50), (90, 120), (220, 120), (220, 200))]

    def scan(boxes, paths):
        p = spark.createDataFrame(boxes, "graph_id string, id string, x double, y double, width double, height double")
        q = spark.createDataFrame(paths, "graph_id string, id string, xs array<double>, ys array<double>")
        return {k: v for k, v in layout.gate_scan(g, p, q).first().asDict().items() if k != "graph_id" and v}

    assert scan(fine, straight) == {}
    assert scan([*fine[:3], box("d", 150, 20)], straight[:1])["box_overlaps"] == 1
    assert scan(fine[:3], straight[:1]) == {"unplaced_nodes": 1, "unrouted_edges": 2}
    assert scan([*fine[:3], box("d", float("nan"), 0)], straight)["not_finite"] == 1
    assert scan(fine, [path(("a", "b"), (50, 50), (60, 200)), *straight[1:]]) == {"slanted_routes": 1}
    assert scan(fine, [path(("a", "b"), (50, 60), (50, 190)), *straight[1:]])["loose_routes"] == 1
    assert scan(fine, [*straight[:2], path(("a", "d"), (90, 50), (90, 225), (200, 225))])["routes_through_boxes"] == 1
    assert scan(fine, [path(("a", "b"), (50, 50), (50, 100), (250, 100), (250, 180), (50, 180), (50, 200)), *straight[1:]])["shared_lines"] == 1


def test_lcs_against_recursion(spark):
    from functools import lru_cache

    @lru_cache(None)
    def longest(a, b):
        return 0 if not a or not b else 1 + longest(a[1:], b[1:]) if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    r = random.Random(23)
    rows = [("".join(r.choice("abc") for _ in range(r.randint(0, 9))), "".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", scalars.lcs_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(x.s == (2 * longest(x.a, x.b) / (len(x.a) + len(x.b)) if x.a or x.b else 1.0) for x in got)


def test_hulls_hold_all_their_points(spark):
    r = random.Random(29)
    rows = [("g", f"c{k}", float(r.randint(0, 40)), float(r.randint(0, 40))) for k in range(5) for _ in range(50)]
    for h in layout.convex_hulls(spark.createDataFrame(rows, "graph_id string, cluster string, x double, y double")).collect():
        corners = list(zip(h.xs, h.ys))
        own = {(x, y) for _, c, x, y in rows if c == h.cluster}
        turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        assert set(corners) <= own and all(turn(a, b, p) >= 0 for a, b in zip(corners, corners[1:] + corners[:1]) for p in own)


def test_inversions_and_crossings(spark):
    r = random.Random(37)
    rows = [("g", k % 4, r.randint(0, 12), r.randint(0, 12)) for k in range(200)]
    got = {x["rank"]: x.crossings for x in layout.crossings(spark.createDataFrame(rows, "graph_id string, rank long, u long, v long")).collect()}
    assert got == {k: sum(a[2] < b[2] and a[3] > b[3] for a in rows for b in rows if a[1] == b[1] == k) for k in range(4)}


def test_order_search_never_adds_crossings(spark):
    g = make(spark, [f"n{i}" for i in range(24)], [(f"n{i}", f"n{(i * 7 + k * 5) % 24}") for i in range(24) for k in (1, 2) if (i * 7 + k * 5) % 24 > i])
    x = layout.crossing_search(g).first()
    assert x.crossings_after <= x.crossings_before and x.layers > 1
