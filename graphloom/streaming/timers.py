"""Streams in which silence counts: health and restarts of nodes, micro-batches that are flushed by size or age.

State and timers are those of ``transformWithState``, so they are kept by key, checkpointed, and outlive lost executors;
a session needs the RocksDB state store (``use_timers``). In processing time, timers go off although no packet comes.
In event time they go off when the watermark, moved by other keys' packets, passes them, so results can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.runtime import prepare_python
from graphloom.streaming.healing import DEAD_MS, DEGRADED_MS, RESTARTS

HEALTH = "node_id string, health string, at_ms bigint, silent_ms bigint, attempt int"
BATCHES = "topic string, number bigint, reason string, packets array<string>"


def use_timers(spark: SparkSession) -> None:
    """The state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Health(StatefulProcessor):
    """healthy on a packet; degraded, then dead, when none comes; after that restarts with growing delays, then failed.

    What is due is told by the last packet and the health alone. A timer, or a packet, first carries out what is due before
    it; so timers of a node that has spoken since pass without effect, and gaps count though packets overtake timers.
    """

    def __init__(self, event_time: bool, degraded: int, dead: int, restarts: int, delay: int, most: int):
        self.event_time, self.degraded, self.dead = event_time, degraded, dead
        self.restarts, self.delay, self.most = restarts, delay, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last bigint, health string, attempt int")

    def due(self, last: int, health: str, attempt: int) -> int | None:
        """When the next change comes if no packet does."""
        if health == "failed":
            return None
        if health == "healthy":
            return last + self.degraded
        if health == "degraded":
            return last + self.dead
        return last + self.dead + sum(min(self.delay << k, self.most) for k in range(attempt + 1))

    def advance(self, state: tuple, until: int) -> tuple[tuple, list[tuple]]:
        """The state once everything due up to then has happened, and the changes: health, at, silent, attempt."""
        changes = []
        while (at := self.due(*state)) is not None and at <= until:
            last, health, attempt = state
            if health in ("healthy", "degraded"):
                state = (last, "degraded" if health == "healthy" else "dead", 0)
            else:
                state = (last, "restarting", attempt + 1) if attempt < self.restarts else (last, "failed", attempt)
            changes.append((state[1], at, at - last, state[2]))
        return state, changes

    def _done(self, key, state: tuple, changes: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update(state)
        if (at := self.due(*state)) is not None:
            self.handle.registerTimer(at)
        if changes:
            frame = pd.DataFrame([(key[0], *c) for c in changes], columns=["node_id", "health", "at_ms", "silent_ms", "attempt"])
            yield frame.astype({"attempt": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted({int(t) for f in rows for t in f["at_ms"]})
        times = times if self.event_time else [timerValues.getCurrentProcessingTimeInMs()]
        state, changes = (self.state.get() if self.state.exists() else None), []
        for t in times:
            if state is not None:
                if t <= state[0]:
                    continue
                state, more = self.advance(tuple(state), t - 1)
                changes += more
            if state is None or state[1] != "healthy":
                changes.append(("healthy", t, 0, 0))
            state = (t, "healthy", 0)
        yield from self._done(key, tuple(state), changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        state, changes = self.advance(tuple(self.state.get()), max(now, expiredTimerInfo.getExpiryTimeInMs()))
        if changes:
            yield from self._done(key, state, changes)

    def close(self) -> None:
        pass


def health(
    packets: DataFrame, event_time: bool = False, late: str = "0 seconds", degraded: int = DEGRADED_MS, dead: int = DEAD_MS,
    restarts: int = RESTARTS, delay: int = 500, most: int = 30_000,
) -> DataFrame:
    """A stream of changes of nodes' health (``HEALTH``) from packets (node_id, ts): healthy, degraded, dead, restarting with
    its attempt, failed. Packets without a node are left out; late and repeated ones change nothing."""
    prepare_python(packets.sparkSession)
    p = packets.filter("node_id is not null")
    p = (p.withWatermark("ts", late) if event_time else p).select("node_id", "ts", F.unix_millis("ts").alias("at_ms"))
    processor = _Health(event_time, degraded, dead, restarts, delay, most)
    return p.groupBy("node_id").transformWithStateInPandas(processor, HEALTH, "Append" if event_time else "Update", "EventTime" if event_time else "ProcessingTime")


class _Flush(StatefulProcessor):
    """Keeps a topic's packets until there are enough, or the first of them is old enough."""

    def __init__(self, size: int, age: int):
        self.size, self.age = size, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "packet string")
        self.count = handle.getValueState("count", "number bigint, due bigint")

    def _out(self, key, number: int, reason: str, packets: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"topic": [key[0]], "number": [number], "reason": [reason], "packets": [packets]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, due = self.count.get() if self.count.exists() else (0, 0)
        held = [r[0] for r in self.pending.get()] if self.pending.exists() else []
        was_empty = not held
        for frame in rows:
            held += frame["packet"].tolist()
            while len(held) >= self.size:
                yield self._out(key, number, "size", held[: self.size])
                held, number, was_empty = held[self.size :], number + 1, True
        if held and was_empty:
            due = timerValues.getCurrentProcessingTimeInMs() + self.age
            self.handle.registerTimer(due)
        self.pending.put([(p,) for p in held]) if held else self.pending.clear()
        self.count.update((number, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, due = self.count.get()
        if expiredTimerInfo.getExpiryTimeInMs() == due and self.pending.exists():
            held = [r[0] for r in self.pending.get()]
            self.pending.clear()
            self.count.update((number + 1, 0))
            if held:
                yield self._out(key, number, "age", held)

    def close(self) -> None:
        pass


def flushed(packets: DataFrame, size: int = 100, age_ms: int = 50, topic: str = "topic") -> DataFrame:
    """A stream of micro-batches (``BATCHES``) by topic: ``size`` packets (as JSON), or what there is once the first has waited
    ``age_ms``. Packets without a topic are one topic."""
    prepare_python(packets.sparkSession)
    p = packets.select(F.coalesce(F.col(topic), F.lit("")).alias("topic"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in packets.columns])).alias("packet"))
    return p.groupBy("topic").transformWithStateInPandas(_Flush(size, age_ms), BATCHES, "Append", "ProcessingTime")
