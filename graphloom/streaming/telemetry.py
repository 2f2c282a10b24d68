"""Telemetry packets as streams: deduplication, shedding, last-write-wins projections, windows, routing, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.runtime import prepare_python

PACKETS = "id string, type string, ts timestamp, sequence bigint, source string, node_id string, agent_id string, priority string, topic string, payload string, arrival bigint"
# Priorities from lowest to highest.
PRIORITIES = ("low", "normal", "high", "critical")


def key() -> Column:
    """A packet's identity: its id, else type, sequence or time, source, node and agent."""
    when = F.coalesce(F.concat(F.lit("seq:"), F.col("sequence").cast("string")), F.concat(F.lit("ts:"), F.unix_millis("ts").cast("string")))
    fallback = F.concat_ws("|", "type", when, F.coalesce("source", F.lit("")), F.coalesce("node_id", F.lit("")), F.coalesce("agent_id", F.lit("")))
    return F.when(F.coalesce("id", F.lit("")) != "", F.col("id")).otherwise(fallback)


def read_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Packets from a folder of JSON lines; ``files`` a trigger is the backpressure."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files).json(path)


def generated(spark: SparkSession, per_second: int = 100) -> DataFrame:
    """A made-up stream of packets."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("value") % len(xs)).cast("int") + 1)
    return r.select(F.concat(F.lit("p"), F.col("value")).alias("id"), pick("node_status", "metric", "log", "token_usage").alias("type"), F.col("timestamp").alias("ts"), F.col("value").alias("sequence"), F.lit("generator").alias("source"), F.concat(F.lit("node-"), F.col("value") % 10).alias("node_id"), F.concat(F.lit("agent-"), F.col("value") % 5).alias("agent_id"), pick(*PRIORITIES).alias("priority"), F.lit("run").alias("topic"), F.to_json(F.struct((F.col("value") % 100).alias("value"), pick("running", "success", "error").alias("status"))).alias("payload"), F.col("value").alias("arrival"))


def deduplicated(packets: DataFrame, ttl: str = "60 seconds") -> DataFrame:
    """One packet a key within the time to live, by event time."""
    return packets.withColumn("packet_key", key()).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["packet_key"])


def first_sights(packets: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """Bounded tables: packets that are no repeat within ``ttl_ms`` of the first sight that let one through.

    The time to live isn't refreshed by repeats, so it is a fold in arrival order for each key.
    """
    prepare_python(packets.sparkSession)
    columns = packets.columns

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows, keep, since = rows.sort_values("arrival"), [], None
        for t in rows["arrival_ms"]:
            fresh = since is None or t - since >= ttl_ms
            since = t if fresh else since
            keep.append(fresh)
        return rows.loc[keep, columns]

    p = packets.withColumn("packet_key", key()).withColumn("arrival_ms", F.unix_millis("ts"))
    p = p.withColumn("sights", F.count(F.lit(1)).over(Window.partitionBy("packet_key")))
    again = p.filter("sights > 1").groupBy("packet_key").applyInPandas(f, packets.schema)
    return p.filter("sights = 1").select(*columns).unionByName(again)


def shed(batch: DataFrame, capacity: int, policy: str = "drop_low_priority") -> DataFrame:
    """At most ``capacity`` packets of a batch: the oldest, the newest or the lowest priorities go."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.coalesce("priority", F.lit("normal")))
    order = {"drop_oldest": [F.desc("arrival")], "drop_newest": [F.asc("arrival")], "drop_low_priority": [F.desc(rank), F.asc("arrival")]}[policy]
    return batch.orderBy(*order).limit(capacity)


def node_status(packets: DataFrame) -> DataFrame:
    """Last status of each node by arrival; packets without one are ignored. For streams, run in complete or update mode."""
    status = F.get_json_object("payload", "$.status")
    p = packets.filter((F.col("type") == "node_status") & status.isNotNull())
    return p.groupBy("node_id").agg(F.max_by(status, "arrival").alias("status"), F.max("arrival").alias("arrival"))


def agent_usage(packets: DataFrame) -> DataFrame:
    """Running token sums of agents, with the last model that was told."""
    tokens = F.coalesce(F.get_json_object("payload", "$.tokens").try_cast("double"), F.lit(0.0))
    model = F.get_json_object("payload", "$.model")
    return packets.filter("agent_id is not null").groupBy("agent_id").agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("packets"), F.max_by(model, F.when(model.isNotNull(), F.col("arrival"))).alias("model"))


def metric_history(packets: DataFrame, last: int = 50) -> DataFrame:
    """The newest samples of each metric (a table or micro-batch)."""
    m = packets.filter("type = 'metric'").select(F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.value").try_cast("double").alias("value"), "arrival")
    nth = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("arrival")))
    return m.withColumn("nth", nth).filter(F.col("nth") <= last)


def latest(packets: DataFrame, kind: str, last: int) -> DataFrame:
    """The newest packets of a type."""
    return packets.filter(F.col("type") == kind).orderBy(F.desc("arrival")).limit(last)


def throughput(packets: DataFrame, window: str = "1 second", slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Packets in tumbling or sliding windows of event time."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    p = packets.withWatermark("ts", late) if packets.isStreaming else packets
    return p.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("packets")).select(F.col("w.start").alias("start"), "packets")


def sessions(packets: DataFrame, gap: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    p = packets.withWatermark("ts", late) if packets.isStreaming else packets
    return p.groupBy("agent_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("packets")).select("agent_id", F.col("w.start").alias("start"), "packets")


def selected(packets: DataFrame, types=None, nodes=None, agents=None, topics=None, text: str = "") -> DataFrame:
    for c, members in (("type", types), ("node_id", nodes), ("agent_id", agents), ("topic", topics)):
        packets = packets.filter(F.col(c).isin(*members)) if members else packets
    return packets.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(text.lower()))) if text else packets


def route(packets: DataFrame, sinks: dict[str, tuple[Column, Callable[[DataFrame, int], None]]], checkpoint: str, trigger: str = "50 milliseconds"):
    """Write each micro-batch to the sinks whose predicate it meets; returns the running query."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for predicate, sink in sinks.values():
            sink(batch.filter(predicate), number)
        batch.unpersist()

    return packets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def status_projection(packets: DataFrame, idle_ms: int = 5000) -> DataFrame:
    """A stream of node health: healthy on any packet, dead when none has come for ``idle_ms`` of processing time."""
    prepare_python(packets.sparkSession)

    def f(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"node_id": [key_[0]], "packets": [n], "health": ["dead"]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"node_id": [key_[0]], "packets": [n], "health": ["healthy"]})

    return packets.groupBy("node_id").applyInPandasWithState(f, "node_id string, packets bigint, health string", "n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)
