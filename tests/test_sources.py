"""Documents, logs, exports."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.sources import export, graph_json
from graphloom.sources.event_log import read_logs, recover


def test_lenient_reading(spark):
    doc = {"nodes": [{"id": "a", "name": 5, "kind": "oven", "step": "second", "tools": [None, {"name": "t"}], "metadata": None, "flour": 3}, {"id": "a"}, {"name": "lost"}, "x", {"id": "b"}], "edges": [{"source": "a", "target": "zz"}, {"source": "a", "target": "b"}, {"id": "e", "source": "b", "target": "a"}, {"id": "e", "source": "b", "target": "a"}], "sections": [{"id": "s", "nodeIds": ["a", "gone"]}]}
    docs = spark.createDataFrame([("g", json.dumps(doc)), ("bad", "{"), ("list", "[]"), ("none", None)], "graph_id string, text string")
    g, warnings = graph_json.read_documents(docs)
    a = g.nodes.filter("id = 'a'").first()
    assert (a.name, a.kind, a.step, json.loads(a.extras)) == ("a", "oven", None, {"flour": 3})
    assert g.nodes.count() == 2 and sorted(r.id for r in g.edges.collect()) == ["e", "edge-1", "edge-3"]
    assert g.sections.first().node_ids == ["a"]
    codes = {(r.graph_id, r.code) for r in warnings.collect()}
    assert {("g", "DUPLICATE_ID"), ("g", "MISSING_ID"), ("g", "UNKNOWN_ENDPOINT"), ("g", "WRONG_TYPE"), ("g", "UNKNOWN_KIND"), ("g", "UNKNOWN_MEMBER"), ("bad", "INVALID_JSON"), ("list", "NOT_A_GRAPH"), ("none", "INVALID_JSON")} <= codes


def test_bundle():
    pack = graph_json.bundle("{}", [{"id": 1}])
    assert graph_json.open_bundle(pack) == ("{}", [{"id": 1}])
    with pytest.raises(ValueError, match="checksum"):
        graph_json.open_bundle(pack.replace('\\"id\\": 1', '\\"id\\": 2'))


def test_log_recovery(spark, tmp_path):
    text = '{"kind": "a"}\n{\n "kind": "b"\n}\nnot json\n{"kind": "c", "payload": {"task_id": "t"}}\n{"kind":'
    records, issues = recover(text.split("\n"))
    assert [i for i, _ in records] == [0, 1, 5] and len(issues) == 2
    (tmp_path / "log.jsonl").write_text(text)
    events, bad = read_logs(spark, str(tmp_path))
    assert [(r.event_index, r.kind, r.actor) for r in events.orderBy("event_index").collect()] == [(0, "a", "system"), (1, "b", "system"), (2, "c", "system")]
    assert bad.count() == 2


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("g", json.dumps({"nodes": [{"id": "a'1", "metrics": {"durationMs": 5}}, {"id": "b"}], "edges": [{"source": "a'1", "target": "b", "label": "l"}]}))], "graph_id string, text string")
    g, _ = graph_json.read_documents(docs)
    tables = export.relational(g)
    assert len(tables) == 10 and "DROP TABLE" in export.ddl(tables, "mysql", "x_", True) and '"x_nodes"' in export.ddl(tables, "postgres", "x_")
    statement = export.inserts(tables["node_metrics"], "node_metrics").filter(F.col("statement").contains("a''1")).first().statement
    assert statement.endswith("VALUES ('g', 'a''1', 5.0, 0.0, NULL, NULL);")
    assert "-->|l|" in export.mermaid(g).first().text and '"b"' in export.dot(g).first().text
    assert json.loads(export.documents(g).first().text)["nodes"][1]["id"] == "b"
    assert export.relational_json(tables).filter("table_name = 'edges'").count() == 1
    assert "| g |" in export.markdown_report(tables["graphs"]) and "<td>g</td>" in export.html_report(tables["graphs"], "t")
    cache = export.LayoutCache(spark, f"file://{tmp_path}/cache")
    assert cache.get("k") is None
    cache.put("k", tables["graphs"])
    assert cache.get("k").count() == 1
    graph_json.upload(docs, f"file://{tmp_path}/up")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        graph_json.upload(docs, f"file://{tmp_path}/up")
