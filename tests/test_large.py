"""What only shows on tables larger than those of the other tests: broadcasts, exchanges, rounds."""

import random
import re
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import collab, drawing, layout, levels
from graphloom.runtime import FREED, scratch_root
from graphloom.schema import GraphFrames
from graphloom.sources import capsules
from graphloom.sources.adapters import flat


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_points_are_never_broadcast(spark, tmp_path):
    """The files of a million points are smaller than the limit of a broadcast, the points are not."""
    r = random.Random(3)
    rows = [("g", f"p{i}", r.uniform(-200, 200), r.uniform(-200, 200)) for i in range(150)]
    spark.createDataFrame(rows, "graph_id string, id string, x double, y double").write.parquet(str(tmp_path / "points"))
    got = collab.near_pairs(spark.read.parquet(str(tmp_path / "points")), 60)
    assert "Broadcast" not in plan(got)
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 60}
    assert {(x.a, x.b) for x in got.collect()} == want


def test_latency_of_a_node_that_took_no_time(spark, tmp_path):
    """Event 90,000 takes 0 ms and has a command of 50 s; the SQL counts recorded durations."""
    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT 89980 + i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(40) t(i)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.sql(entry.oracle_sql()["anomaly_latency"])
    got = entry.queries()["anomaly_latency"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_gates_broadcast_no_nodes_or_edges(spark, tmp_path):
    """Files with many empty columns are small whatever their rows; only counts by graph may be broadcast."""
    g = GraphFrames.of(
        spark.createDataFrame([("g", i, v) for i, v in enumerate("abcd")], "graph_id string, ord long, id string"),
        spark.createDataFrame([("g", i, v + w, v, w) for i, (v, w) in enumerate(("ab", "bd", "ac", "cd", "ad", "da"))], "graph_id string, ord long, id string, source string, target string"),
    )
    kept = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    g = GraphFrames(kept(g.nodes, "nodes"), kept(g.edges, "edges"))
    placed, routes = kept(drawing.layered_layout(g), "placed"), kept(drawing.routes(g), "routes")
    scan = layout.gate_scan(g, placed, routes)
    assert not re.search(r"HashedRelationBroadcastMode\(List\([^)]*input\[1", plan(scan))
    assert [sum(r[1:]) for r in scan.collect()] == [0]


def test_one_drawing_gives_boxes_and_routes(spark):
    """Each graph is drawn once for both tables, and no customer is broadcast for the graphs of their orders."""
    g = GraphFrames.of(
        spark.createDataFrame([("g", i, v) for i, v in enumerate("abc")] + [("h", 0, "x")], "graph_id string, ord long, id string"),
        spark.createDataFrame([("g", i, v + w, v, w) for i, (v, w) in enumerate(("ab", "bc", "ac", "ca", "bb"))], "graph_id string, ord long, id string, source string, target string"),
    )
    placed, routes = drawing.layered_drawing(g)
    for one, other in ((placed, drawing.layered_layout(g)), (routes, drawing.routes(g))):
        assert one.schema.simpleString() == other.schema.simpleString() and sorted(one.collect()) == sorted(other.collect())
    assert not any("Broadcast" in plan(df) for df in flat(spark, "/root/testdata/sf0.001", "loyal"))


def test_segments_are_cut_from_each_route(spark):
    """Repeated points make no segment; routes of one point, or none, have no segments."""
    df = spark.createDataFrame([("g", "e", [0.0, 0.0, 0.0, 5.0], [0.0, 3.0, 3.0, 3.0]), ("g", "f", [1.0], [1.0]), ("g", "h", [], [])], "graph_id string, id string, xs array<double>, ys array<double>")
    got = layout.segments_of(df.withColumn("source", F.lit("s")), "source")
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("g", "e", "s", 0, 0.0, 0.0, 0.0, 3.0), ("g", "e", "s", 2, 0.0, 3.0, 5.0, 3.0)]


def test_rounds_leave_no_tables_behind(spark):
    """A ladder takes a round for each rung; of the tables of all rounds none is left, and the session's settings stay."""
    held = lambda: len(list(Path(scratch_root(spark).removeprefix("file:")).glob("graphloom/*/told")))
    nodes = spark.createDataFrame([("g", f"{s}{i}", 0.0) for i in range(4) for s in "ab"], "graph_id string, id string, start double")
    links = spark.createDataFrame([("g", f"{s}{i}", f"{t}{i + 1}", 1.0) for i in range(3) for s in "ab" for t in "ab"], "graph_id string, src string, dst string, w double")
    before = held()
    got = {r.id: r.value for r in levels.longest(nodes, links).collect()}
    assert got == {f"{s}{i}": float(i) for i in range(4) for s in "ab"}
    assert held() == before and spark.conf.get(FREED, None) is None


def test_documents_are_taken_apart_once(spark):
    """No rule makes the documents again; keys as values, and blank ones, don't mislead the search for entries."""
    text = '{"nodes": [{"id": "evidence_class", "model": "m"}, {"id": "b", "x": [{"evidence_class": "guess"}]}, {"id": "c", "note": "telemetry"}], "edges": [{"id": "e", "evidence_class": 3}]}'
    got = capsules.contract_issues(spark.range(3).select(F.col("id").cast("string").alias("graph_id"), F.lit(text).alias("text")))
    assert "Range" not in plan(got)
    assert sorted((r.graph_id, r.rule, r.path) for r in got.collect()) == sorted((str(i), *x) for i in range(3) for x in (
        ("retired", "dataset.nodes[0] (evidence_class).model"), ("evidence", "dataset.nodes[1] (b).x[0].evidence_class"), ("evidence", "dataset.edges[0] (e).evidence_class")))
