"""Streams whose states change because nothing comes."""

import json
import time
from collections import Counter

import pytest

from graphloom.streaming import timers
from graphloom.streaming.telemetry import read_stream


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    timers.use_timers(spark)
    yield
    spark.conf.set(key, old) if old else spark.conf.unset(key)


def drop(folder, name, packets):
    folder.mkdir(exist_ok=True)
    part = folder / f".{name}"
    part.write_text("".join(json.dumps(p) + "\n" for p in packets))
    part.rename(folder / name)


def packet(node, second, **more):
    return {"id": f"{node}-{second}", "type": "heartbeat", "node_id": node, "ts": f"2024-01-01T00:{int(second) // 60:02d}:{second % 60:06.3f}Z", **more}


def collect(df, folder, enough, mode="update", limit=90):
    """Run a stream until ``enough(rows)``; all rows that it gave."""
    got = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(folder / "ck")).trigger(processingTime="100 milliseconds").start()
    end = time.time() + limit
    while time.time() < end and not enough(got):
        assert q.exception() is None, q.exception()
        time.sleep(0.2)
    q.stop()
    return got


def test_silence_in_processing_time(spark, tmp_path):
    """One file of packets, and then none: the node is degraded, dead, restarted twice and given up."""
    drop(tmp_path / "in", "a.json", [packet("n1", 1.0), packet("n1", 2.0), packet(None, 3.0)])
    df = timers.health(read_stream(spark, str(tmp_path / "in")), degraded=1500, dead=3000, restarts=2, delay=300)
    rows = collect(df, tmp_path, lambda got: any(r.health == "failed" for r in got))
    assert [(r.node_id, r.health, r.silent_ms, r.attempt) for r in rows] == [
        ("n1", "healthy", 0, 0), ("n1", "degraded", 1500, 0), ("n1", "dead", 3000, 0), ("n1", "restarting", 3300, 1), ("n1", "restarting", 3900, 2), ("n1", "failed", 5100, 2),
    ]


def test_silence_in_event_time(spark, tmp_path):
    """Other nodes' packets move time on; a packet of a dead node makes it healthy, and a late one nothing."""
    drop(tmp_path / "in", "1.json", [packet("a", 10.0), packet("b", 10.0)])
    drop(tmp_path / "in", "2.json", [packet("b", 13.0)])
    drop(tmp_path / "in", "3.json", [packet("b", 16.0)])
    drop(tmp_path / "in", "4.json", [packet("a", 17.0), packet("b", 17.0), packet("c", 17.0)])
    drop(tmp_path / "in", "5.json", [packet("b", 40.0)])
    df = timers.health(read_stream(spark, str(tmp_path / "in"), files=1), event_time=True, restarts=1, delay=1000)
    rows = collect(df, tmp_path, lambda got: sum(r.health == "failed" for r in got) >= 2, "append")
    by = {n: [(r.health, r.at_ms % 60_000) for r in rows if r.node_id == n] for n in "abc"}
    assert by["a"][:3] == [("healthy", 10_000), ("degraded", 12_500), ("dead", 15_000)]
    assert ("healthy", 17_000) in by["a"] and by["a"][-4:] == [("degraded", 19_500), ("dead", 22_000), ("restarting", 23_000), ("failed", 25_000)]
    assert by["c"] == [("healthy", 17_000), ("degraded", 19_500), ("dead", 22_000), ("restarting", 23_000), ("failed", 25_000)]
    assert by["b"][0] == ("healthy", 10_000)


def test_flush_by_size_and_age(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [packet("n", k, topic="run", sequence=k) for k in range(25)] + [packet("n", 30, topic=None)])
    df = timers.flushed(read_stream(spark, str(tmp_path / "in")), size=10, age_ms=800)
    rows = collect(df, tmp_path, lambda got: sum(len(r.packets) for r in got) >= 26, "append")
    assert Counter((r.topic, r.reason, len(r.packets)) for r in rows) == {("run", "size", 10): 2, ("run", "age", 5): 1, ("", "age", 1): 1}
    assert [r.number for r in rows if r.topic == "run"] == [0, 1, 2]
    assert sorted(json.loads(p)["sequence"] for r in rows if r.topic == "run" for p in r.packets) == list(range(25))
