"""Live sources against servers of this machine that break off, and recorded feeds; restarts from a checkpoint give each event once."""

import base64
import hashlib
import json
import socket
import struct
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.sources import feeds

TOTAL = 120


def block(i):
    """Every third event has no own id; data may have two lines; comments and blocks without data stand between."""
    own = f"id: {i}\n" if i % 3 else ""
    return f": note\n\nretry: 10\n\n{own}event: {'metric' if i % 2 else 'log'}\ndata: {{\"n\": {i},\ndata:  \"type\": \"t\"}}\n\n"


class Feed(BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        last = self.headers.get("Last-Event-ID")
        Feed.seen.append(last)
        if len(Feed.seen) % 4 == 0:
            self.send_error(503)
            return
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.end_headers()
        first = 0 if last is None else int(last) + 1
        for i in range(first, min(first + 17, TOTAL)):  # the connection ends after a few events, in the middle of one
            self.wfile.write(block(i).encode())
        if first + 17 < TOTAL:
            self.wfile.write(b"id: 999\ndata: cut")
        else:
            self.wfile.flush()
            time.sleep(0.3)


@pytest.fixture
def feed():
    Feed.seen = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/feed"
    server.shutdown()


def gather(spark, source, options, folder, enough, limit=60):
    """Run a stream with a checkpoint until ``enough(rows)``; the rows that it wrote."""
    frame = spark.readStream.format(source).options(**options).load()
    out, query = f"{folder}/out", None
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="50 milliseconds").start()
    end = time.time() + limit
    try:
        while time.time() < end:
            assert query.exception() is None, query.exception()
            try:
                rows = spark.read.schema(feeds.EVENTS).parquet(out).collect()
            except Exception:  # nothing is written yet
                rows = []
            if enough(rows):
                break
            time.sleep(0.3)
    finally:
        query.stop()
    return spark.read.schema(feeds.EVENTS).parquet(out).collect()


def test_event_stream_resumes(spark, feed, tmp_path):
    feeds.register(spark)
    options = {"url": feed, "maxBatchSize": "13", "batchIntervalMs": "200"}
    some = gather(spark, "event_stream", options, str(tmp_path), lambda rows: len(rows) >= 30)
    assert 30 <= len(some) < TOTAL
    whole = gather(spark, "event_stream", options, str(tmp_path), lambda rows: len(rows) >= TOTAL)
    assert Counter(json.loads(r.data)["n"] for r in whole) == Counter(range(TOTAL))
    assert all(r.event == ("metric" if json.loads(r.data)["n"] % 2 else "log") for r in whole)
    assert len(set(Feed.seen)) > 5


def test_event_types_and_first_id(spark, feed, tmp_path):
    feeds.register(spark)
    reader = feeds.EventStreamReader({"url": feed, "lasteventid": "100", "eventtypes": "metric", "batchintervalms": "400"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert [json.loads(r[2])["n"] for r in rows] == [n for n in range(101, TOTAL) if n % 2][: len(rows)] and rows
    assert end["id"] != "100"
    assert list(reader.readBetweenOffsets({"id": "100", "skip": 0}, end)) == rows


def test_parse_lines():
    text = b"id: 1\ndata: a\n\ndata:b\r\ndata\r\n\r\n: x\nid: 2\n\nevent: e\ndata: c\n\ndata: lost"
    assert list(feeds.parse_lines(iter(text.splitlines(keepends=True)))) == [("1", True, "message", "a"), ("1", False, "message", "b\n"), ("2", True, "e", "c")]


def serve_socket(server, total, drop):
    """A web socket server that replays from ``since``, pings, splits messages and drops the connection."""
    while True:
        try:
            c, _ = server.accept()
        except OSError:
            return
        try:
            f = c.makefile("rb")
            key = ""
            while line := f.readline().strip():
                if line.lower().startswith(b"sec-websocket-key:"):
                    key = line.split(b":")[1].strip().decode()
            accept = base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()
            c.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
            _, size = f.read(2)
            mask, body = f.read(4), f.read(size & 0x7F)
            asked = json.loads(bytes(b ^ mask[i % 4] for i, b in enumerate(body)))
            first = max(asked["since"] - 3, 0)  # some again, which the reader passes over
            for i in range(first, min(first + drop, total)):
                text = json.dumps({"type": "metric", "sequence": i, "pad": "x" * (200 if i % 5 else 70_000)}).encode()
                half = len(text) // 2
                for n, part in enumerate((text[:half], text[half:])):
                    head = bytes([(0x01 if n == 0 else 0x80)])
                    head += bytes([len(part)]) if len(part) < 126 else b"\x7e" + struct.pack(">H", len(part)) if len(part) < 1 << 16 else b"\x7f" + struct.pack(">Q", len(part))
                    c.sendall(head + part)
                    if n == 0:
                        c.sendall(b"\x89\x02hi")
            if first + drop >= total:
                time.sleep(0.3)
        except OSError:  # the reader has its batch and is gone
            pass
        finally:
            c.close()


def test_web_socket_resumes(spark, tmp_path):
    feeds.register(spark)
    server = socket.create_server(("127.0.0.1", 0))
    threading.Thread(target=serve_socket, args=(server, 60, 19), daemon=True).start()
    options = {"url": f"ws://127.0.0.1:{server.getsockname()[1]}/live", "maxBatchSize": "11", "batchIntervalMs": "300", "topics": "run"}
    some = gather(spark, "web_socket", options, str(tmp_path), lambda rows: len(rows) >= 15)
    assert 15 <= len(some) < 60
    whole = gather(spark, "web_socket", options, str(tmp_path), lambda rows: len(rows) >= 60)
    server.close()
    assert Counter(int(r.event_id) for r in whole) == Counter(range(60))


def test_recorded_feed(spark, tmp_path):
    """A recorded feed as a table, and as a stream restarted from its checkpoint; packets keep all fields."""
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"f{k}.sse").write_text("".join(f'id: {i}\nevent: metric\ndata: {{"type": "metric", "id": "p{i}", "sequence": {i}, "timestamp": 5000, "payload": {{"a": 1}}}}\n\n' for i in range(k * 10, k * 10 + 10)) + ": end\n\n")
    (tmp_path / "in" / "odd.sse").write_text("id: 90\ndata: plain\ndata: text\n\nevent: ping\ndata: {}\n\nid: 92\n\ndata: [1, 2]\n\n")
    table = feeds.packets(feeds.read_feed(spark, str(tmp_path / "in")))
    assert table.count() == 43
    odd = {(r.id, r.type, r.payload, r.priority) for r in table.filter("sequence is null").collect()}
    assert odd == {("90", "custom", "plain\ntext", "normal"), (None, "ping", "{}", "normal"), (None, "custom", "[1, 2]", "normal")}
    one = table.filter("id = 'p7'").first()
    assert (one.type, one.sequence, one.arrival, one.payload, one.ts.timestamp()) == ("metric", 7, 7, '{"a":1}', 5.0)
    for _ in range(2):
        stream = feeds.read_feed(spark, str(tmp_path / "in"), streaming=True, files=2)
        q = feeds.packets(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert Counter(spark.read.parquet(str(tmp_path / "out")).select("id").toPandas()["id"].fillna("")) == Counter([*(f"p{i}" for i in range(40)), "90", "", ""])


def test_recorded_times_are_the_nearest_milliseconds(spark, tmp_path):
    """Microseconds are rounded as DuckDB's epoch_ms does, on both sides of 1970; absent times stay absent."""
    micros = [None, 0, 499, 500, 1499, 1500, -1, -499, -500, -1499, -1500, 1704067207179499, 1704067207179500, 1704067207179999]
    table = spark.createDataFrame([(i, m) for i, m in enumerate(micros)], "arrival long, m long")
    table = table.selectExpr("'p' || arrival AS id", "'log' AS type", "timestamp_micros(m) AS ts", "'{}' AS payload", "arrival")
    feeds.write_feed(table, str(tmp_path / "feed"))
    got = feeds.packets(feeds.read_feed(spark, str(tmp_path / "feed"))).selectExpr("arrival", "unix_micros(ts) AS m").collect()
    want = duckdb.connect().execute("SELECT i, epoch_ms(make_timestamp(m)) * 1000 FROM (SELECT unnest(?::BIGINT[]) AS m, unnest(range(?)) AS i)", [micros, len(micros)]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_feed_packets_times_exactly(spark):
    """The query's milliseconds against its SQL, digit by digit."""
    duck = duckdb.connect()
    duck.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    want = dict(duck.execute(f"SELECT arrival, ms FROM ({entry.oracle_sql()['feed_packets']})").fetchall())
    got = entry.queries()["feed_packets"](spark, "/root/testdata/sf0.001").select("arrival", "ms").collect()
    assert {r.arrival: r.ms for r in got} == want


def test_feed_that_cannot_replay(feed):
    """A batch that must be read again, from a server that no longer has its end, is an error, not a shorter batch."""
    reader = feeds.EventStreamReader({"url": feed, "maxattempts": "2"})
    with pytest.raises(ConnectionError):
        reader.readBetweenOffsets({"id": "118", "skip": 0}, {"id": "500", "skip": 0})
    with pytest.raises(ConnectionError):
        feeds.EventStreamReader({"url": "http://127.0.0.1:9/none", "maxattempts": "2"}).read({"id": "", "skip": 0})
