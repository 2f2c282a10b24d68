"""Live telemetry: event streams over HTTP, web sockets, and recorded feeds, with resume.

``spark.readStream.format("event_stream")`` and ``format("web_socket")`` are Python stream sources whose offsets are what the
protocols resume by: the last event id, or the last sequence number. Spark checkpoints the offsets, so a query that is
restarted, or loses its connection, asks for what comes after and gives every event once. One connection is one ordered
stream, read in bounded batches on the driver as that source type does; what needs more throughput is recorded to files,
which ``read_feed`` reads as a table or a stream on all executors.

    register(spark)
    events = spark.readStream.format("event_stream").option("url", "http://host/feed").load()
    packets(events).writeStream...
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import ssl
import struct
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

EVENTS = "event_id string, event string, data string"
# Fixed value: the suffix of the handshake's key that the protocol prescribes.
_MAGIC = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"


def parse_lines(lines: Iterator[bytes], last_id: str = "") -> Iterator[tuple[str, bool, str, str]]:
    """Events of a text/event-stream: the last id so far, whether the event has it itself, event type and data.

    An id holds until the next one. Lines that start with a colon are comments; blocks without data set the id only; a
    block that the end of the stream cuts off is no event.
    """
    event, data, own = "message", [], False
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\n").rstrip("\r")
        if line:
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value or "message"
            elif name == "data":
                data.append(value)
            elif name == "id" and "\0" not in value:
                last_id, own = value, True
            continue
        if data:
            yield last_id, own, event, "\n".join(data)
            event, data, own = "message", [], False


class _LiveReader(SimpleDataSourceStreamReader):
    """Batches of at most ``maxBatchSize`` events, or what comes within ``batchIntervalMs``; broken connections are renewed
    after a growing pause, ``maxAttempts`` times in a row."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.most = int(options.get("maxbatchsize", 1000))
        self.wait = float(options.get("batchintervalms", 500)) / 1000
        self.attempts = int(options.get("maxattempts", 8))
        self.options = dict(options)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._collect(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._collect(start, end)[0])

    def _collect(self, start: dict, until: dict | None) -> tuple[list[tuple], dict]:
        """What comes after an offset, up to another one if that is given, and the offset after it."""
        rows, at, failed = [], dict(start), 0
        deadline = time.monotonic() + self.wait

        def is_done() -> bool:
            return at == until if until is not None else len(rows) >= self.most or time.monotonic() >= deadline

        while not is_done():
            before, error = dict(at), None
            try:
                for row, at in self._events(at, deadline if until is None else None):
                    if row is not None:
                        rows.append(row)
                    if is_done():
                        break
                else:
                    if until is None:
                        break  # the server closed an exhausted feed
            except TimeoutError as e:
                if until is None:
                    break
                error = e
            except (OSError, urllib.error.URLError) as e:
                error = e
            if is_done():
                break
            failed = 0 if at != before else failed + 1
            if failed >= self.attempts:
                if until is None and rows:
                    break
                raise ConnectionError(f"{self.url} gives no events after {at}: {error}") from error
            time.sleep(min(0.05 * 2**failed, 5))
            if error is not None:  # what was waited for the connection is not the feed's silence
                deadline = max(deadline, time.monotonic() + self.wait / 2)
        return rows, at

    def _events(self, start: dict, deadline: float | None) -> Iterator[tuple[tuple | None, dict]]:
        """Events after an offset, each with the offset after it."""
        raise NotImplementedError


class EventStreamReader(_LiveReader):
    """Offsets hold the last event id, and how many events without an own id came after it."""

    def initialOffset(self) -> dict:
        return {"id": self.options.get("lasteventid", ""), "skip": 0}

    def _events(self, start: dict, deadline: float | None) -> Iterator[tuple[tuple | None, dict]]:
        headers = {"Accept": "text/event-stream", "Cache-Control": "no-cache"}
        if start["id"]:
            headers["Last-Event-ID"] = start["id"]
        if token := self.options.get("authtoken"):
            headers["Authorization"] = f"Bearer {token}"
        kinds = {k.strip() for k in self.options.get("eventtypes", "").split(",") if k.strip()}
        left = max(deadline - time.monotonic(), 0.05) if deadline is not None else 30
        with urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=left) as response:
            # Events without an own id that follow the last one are sent again: pass over those that were read.
            passed, at = 0, dict(start)
            for last_id, own, event, data in parse_lines(iter(response.readline, b""), start["id"]):
                if own:
                    at = {"id": last_id, "skip": 0}
                elif at["id"] == start["id"] and passed < start["skip"]:
                    passed += 1
                    continue
                else:
                    at = {"id": last_id, "skip": at["skip"] + 1}
                yield ((last_id or None, event, data) if not kinds or event in kinds else None), dict(at)


class _Socket:
    """A client's side of one web socket: texts in, texts out."""

    def __init__(self, url: str, timeout: float, token: str | None = None):
        parts = urlsplit(url)
        secure = parts.scheme in ("wss", "https")
        self.raw = socket.create_connection((parts.hostname, parts.port or (443 if secure else 80)), timeout)
        if secure:
            self.raw = ssl.create_default_context().wrap_socket(self.raw, server_hostname=parts.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        lines = [f"GET {path} HTTP/1.1", f"Host: {parts.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        lines += [f"Authorization: Bearer {token}"] if token else []
        self.raw.sendall("\r\n".join([*lines, "", ""]).encode())
        self.file = self.raw.makefile("rb")
        head = []
        while line := self.file.readline().strip():
            head.append(line.decode("latin-1"))
        want = base64.b64encode(hashlib.sha1((key + _MAGIC).encode()).digest()).decode()
        if not head or " 101 " not in head[0] + " " or not any(x.lower().startswith("sec-websocket-accept:") and x.split(":", 1)[1].strip() == want for x in head):
            raise ConnectionError(f"no web socket: {head[:1]}")

    def send(self, payload: bytes, kind: int = 1) -> None:
        mask = os.urandom(4)
        size = len(payload)
        head = bytes([0x80 | kind, 0x80 | (size if size < 126 else 126 if size < 1 << 16 else 127)])
        head += b"" if size < 126 else struct.pack(">H" if size < 1 << 16 else ">Q", size)
        self.raw.sendall(head + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(payload)))

    def _exactly(self, n: int) -> bytes:
        got = self.file.read(n)
        if got is None or len(got) < n:
            raise ConnectionError("the web socket ended")
        return got

    def texts(self) -> Iterator[str]:
        """Whole messages; pings are answered, and a close ends them."""
        whole = b""
        while True:
            first, second = self._exactly(2)
            size = second & 0x7F
            size = struct.unpack(">H", self._exactly(2))[0] if size == 126 else struct.unpack(">Q", self._exactly(8))[0] if size == 127 else size
            body = self._exactly(size)
            kind = first & 0x0F
            if kind == 8:
                return
            if kind == 9:
                self.send(body, 10)
            elif kind in (0, 1, 2):
                whole += body
                if first & 0x80:
                    yield whole.decode("utf-8", "replace")
                    whole = b""

    def close(self) -> None:
        self.file.close()
        self.raw.close()


class WebSocketReader(_LiveReader):
    """Offsets hold the last sequence number of a packet. Topics are subscribed with ``since``, and packets up to it passed
    over, so a server that replays gives each once; packets without a number can't be asked for again and come once at most."""

    def initialOffset(self) -> dict:
        return {"sequence": int(self.options.get("since", -1)), "skip": 0}

    def _events(self, start: dict, deadline: float | None) -> Iterator[tuple[tuple | None, dict]]:
        left = max(deadline - time.monotonic(), 0.05) if deadline is not None else 30
        link = _Socket(self.url, left, self.options.get("authtoken"))
        try:
            for topic in [t.strip() for t in self.options.get("topics", "*").split(",")]:
                link.send(json.dumps({"action": "subscribe", "topic": topic, "since": start["sequence"]}).encode())
            at = dict(start)
            for text in link.texts():
                try:
                    packet = json.loads(text)
                except ValueError:
                    packet = None
                number = packet.get("sequence") if isinstance(packet, dict) else None
                if isinstance(number, int):
                    if number <= at["sequence"]:
                        continue
                    at = {"sequence": number, "skip": 0}
                else:
                    at = {"sequence": at["sequence"], "skip": at["skip"] + 1}
                if isinstance(packet, dict) and packet.get("type") in ("ping", "pong", "heartbeat"):
                    yield None, dict(at)
                else:
                    yield (None if number is None else str(number), "message", text), dict(at)
        finally:
            link.close()


class _Source(DataSource):
    reader_class: type[_LiveReader]

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema: T.StructType) -> _LiveReader:
        return self.reader_class({k.lower(): v for k, v in self.options.items()})


class EventStreamSource(_Source):
    """Server-sent events. Options: url, lastEventId, eventTypes, authToken, maxBatchSize, batchIntervalMs, maxAttempts."""

    reader_class = EventStreamReader

    @classmethod
    def name(cls) -> str:
        return "event_stream"


class WebSocketSource(_Source):
    """Web sockets. Options: url, topics, since, authToken, maxBatchSize, batchIntervalMs, maxAttempts."""

    reader_class = WebSocketReader

    @classmethod
    def name(cls) -> str:
        return "web_socket"


def register(spark: SparkSession) -> None:
    """Make the formats ``event_stream`` and ``web_socket`` known to a session."""
    for source in (EventStreamSource, WebSocketSource):
        spark.dataSource.register(source)


def read_feed(spark: SparkSession, path: str, streaming: bool = False, files: int = 8, end: str = "\n\n") -> DataFrame:
    """Events of recorded feeds (text/event-stream files of a folder), as a table or a stream of whole files.

    A block of lines is a row, so files are split and parsed on all executors by built-in expressions.
    """
    reader = (spark.readStream.option("maxFilesPerTrigger", files) if streaming else spark.read).option("lineSep", end)
    return parse_blocks(reader.text(path))


def parse_blocks(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Rows of whole blocks as events; those without data are none. An event's id is its own, not that of an earlier one."""
    lines = F.split(F.col(column), r"\r?\n")

    def values(name: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(f"{name}:") | (x == name))
        return F.transform(own, lambda x: F.regexp_replace(F.substring(x, len(name) + 2, 1 << 30), "^ ", ""))

    ids, kinds, data = values("id"), values("event"), values("data")
    events = blocks.filter(F.exists(lines, lambda x: x.startswith("data:") | (x == "data")))
    kind = F.element_at(kinds, -1)
    return events.select(
        F.when(F.size(ids) > 0, F.nullif(F.element_at(ids, -1), F.lit(""))).alias("event_id"),
        F.when((F.size(kinds) > 0) & (kind != ""), kind).otherwise("message").alias("event"), F.array_join(data, "\n").alias("data"),
    )


def write_feed(packets: DataFrame, path: str) -> None:
    """Record packets as a feed: the arrival as id, the type as event, the packet as JSON.

    Times are in whole milliseconds, the nearest ones; halves go away from 1970.
    """
    names = {"ts": "timestamp", "node_id": "nodeId", "agent_id": "agentId"}
    nearest = F.expr("(unix_micros(ts) div 500 + if(unix_micros(ts) < 0, -1, 1)) div 2")
    kept = [nearest.alias("timestamp") if c == "ts" else F.col(c).alias(names.get(c, c)) for c in packets.columns if c not in ("arrival", "payload")]
    body = F.to_json(F.struct(*kept))
    body = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(', "payload": '), F.coalesce("payload", F.lit("null")), F.lit("}"))
    block = F.concat(F.lit("id: "), F.col("arrival").cast("string"), F.lit("\nevent: "), F.col("type"), F.lit("\ndata: "), body)
    packets.select(block.alias("value")).write.option("lineSep", "\n\n").text(path)


def packets(events: DataFrame) -> DataFrame:
    """Events as telemetry packets.

    Data that is a JSON object with a type is a packet; its payload is itself where it has none. Other data is the payload of
    a packet of the event's type, or ``custom``. A packet without an id has the event's; priority is ``normal`` unless given.
    """
    kinds = "id string, type string, timestamp double, sequence bigint, source string, nodeId string, agentId string, priority string, topic string, payload string"
    body = F.from_json("data", kinds)
    e = events.withColumn("_p", F.when(body["type"].isNotNull(), body))
    number = F.col("event_id").try_cast("bigint")
    return e.select(
        F.coalesce(F.nullif(F.col("_p.id"), F.lit("")), "event_id").alias("id"),
        F.coalesce("_p.type", F.when(F.col("event") != "message", F.col("event")), F.lit("custom")).alias("type"),
        F.timestamp_millis(F.col("_p.timestamp").cast("bigint")).alias("ts"), F.col("_p.sequence").alias("sequence"), F.col("_p.source").alias("source"),
        F.col("_p.nodeId").alias("node_id"), F.col("_p.agentId").alias("agent_id"), F.coalesce("_p.priority", F.lit("normal")).alias("priority"), F.col("_p.topic").alias("topic"),
        F.coalesce("_p.payload", "data").alias("payload"), F.coalesce(number, "_p.sequence").alias("arrival"),
    )
