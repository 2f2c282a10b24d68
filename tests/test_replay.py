"""The state of event logs by distributed maxima against one ordered fold, on random logs that are cut anywhere."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import replay
from tests import folded

VERBS = [*replay.CREATE, *replay.CLAIM, *replay.RUN, *replay.FAIL, *replay.PASS, *replay.REMOVE, *replay.EDGE_REMOVE, "plan-compiled", "note"]
SCHEMA = "log_id string, event_index long, kind string, actor string, payload string, projection string"


def random_log(name, n, seed):
    r = random.Random(seed)
    ids = [f"t{k}" for k in range(6)]
    out = []
    for i in range(n):
        payload = r.choice([{"task_id": r.choice(ids)}, {"id": r.choice(ids)}, {"edge_id": f"{r.choice(ids)}->{r.choice(ids)}"}, {}, {"task_id": "", "id": r.choice(ids)}])
        if r.random() < 0.5:
            payload |= {"passed": r.choice([True, False, None]), "agent": "a1"}
        projection = None
        if r.random() < 0.15:
            tasks = [{"id": r.choice([*ids, None]), "status": r.choice(["done", "Failed", "open", "cached", "running", None, "odd"]), "lease": r.choice([None, "", "L9"])} for _ in range(r.randint(0, 3))]
            nodes = [{"id": r.choice(ids), "status": r.choice(["done", None]), **({"kind": "tool"} if r.random() < 0.5 else {})} for _ in range(r.randint(0, 3))]
            edges = [{"source": r.choice(ids), "target": r.choice(ids)} for _ in range(r.randint(0, 4))]
            projection = r.choice([{"tasks": tasks}, {"tasks": tasks, "graph": {"nodes": nodes, "edges": edges}}, {"graph": {"nodes": nodes}}, {"graph": {"edges": edges}}])
        out.append((name, i, r.choice(VERBS), r.choice([None, "", "bob"]), json.dumps(payload) if payload or r.random() < 0.5 else None, None if projection is None else json.dumps(projection)))
    return out


@pytest.fixture(scope="module")
def logs(spark):
    rows = [e for k in range(12) for e in random_log(f"log{k}", 120, k)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def before(rows, index):
    out = {}
    for e in rows:
        if e[1] <= index:
            out.setdefault(e[0], []).append(dict(zip(("log_id", "event_index", "kind", "actor", "payload", "projection"), e)))
    return {name: folded.fold(events) for name, events in out.items()}


@pytest.mark.parametrize("index,block", [(119, 10_000), (119, 1), (60, 7), (3, 2), (-1, 5)])
def test_state_at(logs, index, block):
    rows, log = logs
    got = {tuple(r) for r in replay.state_at(log, index, block).collect()}
    want = set()
    for name, s in before(rows, index).items():
        for t in set(s["tasks"]) | set(s["nodes"]):
            want.add((name, t, s["tasks"].get(t) or s["nodes"][t]["status"], s["leases"].get(t), t in s["failed"], (s["nodes"].get(t) or {}).get("kind")))
    assert got == want


@pytest.mark.parametrize("index", [119, 50])
def test_edges_at(logs, index):
    rows, log = logs
    got = {tuple(r) for r in replay.edges_at(log, index).collect()}
    assert got == {(name, *x) for name, s in before(rows, index).items() for x in s["edges"].values()}


def test_place_of_each_log(logs):
    """The place may be a column: here the half of each log."""
    rows, log = logs
    half = log.withColumn("half", F.when(F.col("log_id") == "log1", 10).otherwise(60))
    got = {tuple(r) for r in replay.state_at(half, F.col("half")).filter("log_id = 'log1'").collect()}
    assert got == {tuple(r) for r in replay.state_at(log.filter("log_id = 'log1'"), 10).collect()}


def test_one_busy_entity(spark):
    """Many events of one task in one log."""
    log = spark.range(20_000).select(F.lit("l").alias("log_id"), F.col("id").alias("event_index"), F.when(F.col("id") == 0, "task-added").when(F.col("id") % 3 == 0, "task-rejected").otherwise("task-submitted").alias("kind"), F.lit("a").alias("actor"), F.lit('{"task_id": "t"}').alias("payload"), F.lit(None).cast("string").alias("projection"))
    assert [tuple(r) for r in replay.state_at(log, 1 << 40, 500).collect()] == [("l", "t", "running", None, True, "agent")]
