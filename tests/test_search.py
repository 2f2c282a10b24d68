"""The search language on a small graph."""

import json

import pytest

from graphloom.plans.search import parse, search, validate
from graphloom.plans.search.lexer import parse_number
from graphloom.sources.graph_json import read_documents

DOC = {
    "nodes": [
        {"id": "node-1", "name": "Lead", "kind": "orchestrator", "status": "running", "model": "alpha-2", "metrics": {"durationMs": 4500, "tokensIn": 8000, "tokensOut": 2500, "costUsd": 0.045, "retries": 0}},
        {"id": "worker-2", "name": "Parser worker", "kind": "agent", "status": "success", "tools": [{"name": "view_file"}], "metrics": {"durationMs": 1200, "tokensIn": 15000, "tokensOut": 4000, "retries": 1}, "metadata": {"findings": [{"id": "f1", "severity": "minor"}]}},
        {"id": "gate-3", "name": "Gate", "kind": "gate", "status": "error", "metrics": {"durationMs": 850, "tokensIn": 5000, "tokensOut": 800}, "metadata": {"findings": [{"id": "f2", "severity": "critical"}], "custom": {"depth": "deep"}}},
        {"id": "tool-4", "name": "Tool", "kind": "tool", "status": "cached"},
    ],
    "edges": [{"id": "e1", "source": "node-1", "target": "worker-2", "kind": "spawn", "tokens": 3500}, {"id": "e2", "source": "worker-2", "target": "gate-3", "kind": "pushback", "traffic": {"status": "error", "tokens": 1200}}],
}


@pytest.fixture(scope="module")
def graphs(spark):
    docs = spark.createDataFrame([("g", json.dumps(DOC))], "graph_id string, text string")
    g, _ = read_documents(docs)
    return g


def ids(g, q, **o):
    return [r.id for r in search(g, q, **o).collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("status:running", ["node-1"]),
        ("status=error", ["gate-3", "e2"]),
        ("duration>1s", ["node-1", "worker-2"]),
        ("duration:500ms..1s", ["gate-3"]),
        ("tokens>10k", ["node-1", "worker-2"]),
        ("cost>0.01$", ["node-1"]),
        ("id:/worker-\\d+/", ["worker-2"]),
        ("tool:view_file", ["worker-2"]),
        ("severity:critical", ["gate-3"]),
        ("status:in(error, running)", ["node-1", "gate-3", "e2"]),
        ("kind:spawn", ["e1"]),
        ("status:error AND tokens>1000", ["gate-3", "e2"]),
        ("NOT status:error kind:gate", []),
        ("custom.depth:deep", ["gate-3"]),
        ("(kind=tool OR kind=gate) !status:error", ["tool-4"]),
        ("name~paser", ["worker-2"]),
    ],
)
def test_matches(graphs, query, want):
    assert sorted(ids(graphs, query)) == sorted(want)


def test_null_and_array_semantics(graphs):
    assert sorted(ids(graphs, "severity!=critical", edges=False)) == ["node-1", "tool-4", "worker-2"]
    assert "tool-4" in ids(graphs, "cost!=5", edges=False) and ids(graphs, "cost=5") == []


def test_scores_and_order(graphs):
    rows = search(graphs, "worker").collect()
    assert rows[0].id == "worker-2" and rows[0].score >= rows[-1].score
    assert {r.id: r.score for r in search(graphs, "status=success AND retries=1").collect()} == {"worker-2": 3 * 10.0 + 10.0}


def test_highlights(graphs):
    spans = search(graphs, "name:parse", edges=False, highlights=True).first().highlights
    assert (spans[0].field, spans[0].start, spans[0].end, spans[0].text) == ("name", 0, 5, "Parse")


@pytest.mark.parametrize(("text", "want"), [("500ms", 500), ("2.5s", 2500), ("1.5min", 90000), ("1h", 3600000), ("10k", 10000), ("2.5M", 2500000), ("100kb", 102400), ("1mb", 1048576), ("$0.05", 0.05), ("", None), ("2B", 2), ("5m", 5e6)])
def test_units(text, want):
    assert parse_number(text) == want


@pytest.mark.parametrize(("query", "code"), [("(a", "UNBALANCED_PARENTHESES"), ("a)", "UNBALANCED_PARENTHESES"), ('"open', "UNTERMINATED_STRING"), ("/invalid(/", "INVALID_REGEX"), ("a AND", "MISSING_OPERAND"), ("status:", "EMPTY_PREDICATE"), ("f:[a", "UNBALANCED_BRACKETS"), ("duration:5..1", "INVALID_RANGE")])
def test_problems(query, code):
    assert code in [p.code for p in validate(query)]
    assert parse(query)[0] is not None


def test_suggestions(graphs):
    from graphloom.plans.search.compiler import suggest

    assert ("value", "gate") in suggest(graphs, "kind:ga") and ("field", "status") in suggest(graphs, "sta")


def test_dictionary(graphs):
    """Suggestions from a stored dictionary are ranges of its keys, most frequent first."""
    from graphloom.plans.search import dictionary
    from graphloom.plans.search.compiler import suggest

    counts = dictionary.value_counts(graphs)
    d = dictionary.store(counts)
    assert ("value", "gate") in suggest(graphs, "kind:GA", dictionary=d)
    assert dictionary.completions(d, "no-such-field", "x").count() == 0
    twice = {(r["field"], r.value): r.n for r in dictionary.merge(counts, counts).collect()}
    assert twice == {(r["field"], r.value): 2 * r.n for r in counts.collect()}
    plan = dictionary.completions(d, "status", "er")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(field), " in plan and "StartsWith(key" in plan
