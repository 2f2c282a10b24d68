"""Layered drawings by brute force: distances, straight long edges, lanes, ports, gates over graphs with loops and parallel edges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import drawing, layout
from graphloom.schema import GraphFrames


def random_graph(r, loops=True):
    n = r.choice([1, 2, 4, 8, 15, 30])
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(r.choice([0, n, 2 * n]))]
    return n, [p for p in pairs if loops or p[0] != p[1]]


def plain(n, pairs, r):
    nodes = [{"id": f"n{i}", "chars": r.randint(1, 30), "ord": i} for i in range(n)]
    return nodes, [{"id": f"e{k}", "source": f"n{a}", "target": f"n{b}", "is_cycle": False, "weight": 1.0, "min_len": 1} for k, (a, b) in enumerate(pairs)]


@pytest.mark.parametrize("seed", range(8))
def test_coordinates(seed):
    r = random.Random(seed)
    for _ in range(40):
        rank, layers, x, chains, width = drawing.drawn(*plain(*random_graph(r), r))
        for layer in layers:
            for a, b in zip(layer, layer[1:]):
                assert x[b] - x[a] >= (width.get(a, layout.LANE) + width.get(b, layout.LANE)) / 2 + layout.GAP_X - 1e-6
        dummies = {d for c in chains.values() for d in c[1:-1]}
        barred = drawing.conflicts(layers, [s for c in chains.values() for s in zip(c, c[1:])], dummies)
        for c in chains.values():
            assert all((a, b) in barred or abs(x[a] - x[b]) < 1e-6 for a, b in zip(c[1:-1], c[2:-1]))


def test_conflicts():
    """Of crossing segments, outer ones give way to inner ones, and of two inner ones the later."""
    layers = [["a", "d1", "d2"], ["e1", "b", "e2"]]
    segments = [("a", "b"), ("d1", "e1"), ("d2", "e2"), ("d2", "b")]
    inner = {"d1", "d2", "e1", "e2"}
    assert drawing.conflicts(layers, segments, inner) == {("a", "b")}
    assert drawing.conflicts(layers, [("d1", "e2"), ("d2", "e1")], inner) == {("d2", "e1")}


@pytest.mark.parametrize("seed", range(5))
def test_lanes(seed):
    """No two runs of a lane and no two vertical lines meet, whatever circles the nets' demands form."""
    r = random.Random(seed)
    for _ in range(200):
        k = r.randint(0, 9)
        nets = list(zip(r.sample([10.0 * i for i in range(12)], k), r.sample([10.0 * i for i in range(12)], k)))
        lanes, lines = defaultdict(list), defaultdict(list)
        for net, (runs, (a, b)) in enumerate(zip(drawing.lanes_of(nets), nets)):
            runs = sorted(runs, key=lambda q: q[2])
            assert bool(runs) == (a != b)
            x, y = a, 0
            for p, q, lane in runs:
                assert p == x and lane + 1 > y
                lines[p].append((y, lane + 1, net))
                lanes[lane].append((min(p, q), max(p, q), net))
                x, y = q, lane + 1
            assert x == b
            lines[b].append((y, 100, net))
        for some, gap in ((lanes, 1e-9), (lines, 0)):
            for parts in some.values():
                parts.sort()
                assert all(u[2] == v[2] or v[0] >= u[1] + gap for i, u in enumerate(parts) for v in parts[i + 1 :])


def test_circle_of_two_nets():
    assert sorted(len(x) for x in drawing.lanes_of([(0.0, 10.0), (10.0, 0.0)])) == [1, 2]


@pytest.fixture(scope="module")
def graphs(spark):
    r = random.Random(9)
    nodes, edges = [], []
    for k in range(25):
        n, pairs = random_graph(r)
        nodes += [(f"g{k}", i, f"n{i}", "x" * r.randint(1, 30)) for i in range(n)]
        edges += [(f"g{k}", i, f"e{i}", f"n{a}", f"n{b}", "calls" if i % 3 else None) for i, (a, b) in enumerate(pairs + pairs[: len(pairs) // 3])]
    return GraphFrames.of(spark.createDataFrame(nodes, "graph_id string, ord long, id string, name string"), spark.createDataFrame(edges, "graph_id string, ord long, id string, source string, target string, label string"))


def test_gates(graphs):
    placed, paths = drawing.layered_layout(graphs), drawing.routes(graphs)
    v = layout.gate_scan(graphs, placed, paths)
    assert v.count() == 25
    assert v.filter(" or ".join(f"{c} > 0" for c in v.columns if c != "graph_id")).collect() == []


def test_gates_find_faults(graphs):
    """Drawings that are spoilt on purpose don't pass."""
    placed, paths = drawing.layered_layout(graphs), drawing.routes(graphs)
    total = lambda p, r: layout.gate_scan(graphs, p, r).drop("graph_id").groupBy().sum().first().asDict()
    assert total(placed.withColumn("x", F.lit(0.0)), paths)["sum(box_overlaps)"] > 0
    assert total(placed, paths.withColumn("ys", F.transform("ys", lambda y, i: y + i)))["sum(slanted_routes)"] > 0
    flat = paths.withColumn("xs", F.transform("xs", lambda x: F.round(x / 300) * 300))
    assert total(placed, flat)["sum(shared_lines)"] > 0


def test_ports_and_badges(graphs):
    r = drawing.routes(graphs).join(graphs.edges.select("graph_id", "id", "source", "target"), ["graph_id", "id"]).collect()
    ends = [(x.graph_id, v, side, port) for x in r for v, side, port in ((x.source, x.out_side, x.out_port), (x.target, x.in_side, x.in_port))]
    assert len(ends) == len(set(ends))
    for x in r:
        assert {x.out_side, x.in_side} == ({"right"} if x.source == x.target else {"top", "bottom"})
        assert x.is_reversed == (x.out_side == "top")
    b = drawing.badges(graphs, drawing.routes(graphs))
    assert b.count() == graphs.edges.filter("label is not null").count()
    assert {x.width for x in b.collect()} == {7.0 * 5 + 12}
