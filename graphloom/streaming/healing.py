"""Self-healing: heartbeats, health, circuit breakers, playbooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import broadcast_if_few, prepare_python

# Milliseconds without a heartbeat until degraded and dead; restart attempts.
DEGRADED_MS, DEAD_MS, RESTARTS = 2500, 5000, 5


def node_health(beats: DataFrame, now: Column) -> DataFrame:
    """Health of nodes from their last heartbeat (node_id, ts ms)."""
    last = beats.groupBy("node_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("beats"))
    age = now - F.col("last")
    return last.withColumn("age_ms", age).withColumn("health", F.when(age >= DEAD_MS, "dead").when(age >= DEGRADED_MS, "degraded").otherwise("healthy"))


def round_trips(pings: DataFrame, last: int = 20, misses: int = 3) -> DataFrame:
    """Moving mean of round-trip times, and links unhealthy after misses in a row (link, seq, rtt null where missed)."""
    w = Window.partitionBy("link").orderBy("seq")
    p = pings.withColumn("avg_rtt", F.avg("rtt").over(w.rowsBetween(-(last - 1), 0)))
    missed = F.sum(F.when(F.col("rtt").isNull(), 1).otherwise(0)).over(w.rowsBetween(-(misses - 1), 0))
    seen = F.count(F.lit(1)).over(w.rowsBetween(-(misses - 1), 0))
    return p.withColumn("is_unhealthy", (missed == misses) & (seen == misses))


def trip(state: str, fails: int, wins: int, since: float, now: float, ok: bool, limit: int = 5, need: int = 2, wait_ms: float = 10_000) -> tuple[str, int, int, float]:
    """One call through a breaker: what it was, and what it is after."""
    if state == "OPEN":
        if now - since < wait_ms:
            return state, fails, wins, since
        state, wins = "HALF_OPEN", 0
    if state == "HALF_OPEN":
        if not ok:
            return "OPEN", fails, 0, now
        return ("CLOSED", 0, 0, since) if wins + 1 >= need else (state, fails, wins + 1, since)
    if ok:
        return state, 0, 0, since
    return ("OPEN", fails + 1, 0, now) if fails + 1 >= limit else (state, fails + 1, 0, since)


def circuit_breakers(calls: DataFrame, limit: int = 5, need: int = 2, wait_ms: float = 10_000) -> DataFrame:
    """Breaker state after each call (key, ord, ts ms, ok); calls while it is open are refused."""
    prepare_python(calls.sparkSession)

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        s, out = ("CLOSED", 0, 0, 0.0), []
        for r in rows.sort_values("ord").itertuples():
            refused = s[0] == "OPEN" and r.ts - s[3] < wait_ms
            s = trip(*s, r.ts, bool(r.ok), limit, need, wait_ms)
            out.append((r.key, r.ord, s[0], s[1], refused))
        return pd.DataFrame(out, columns=["key", "ord", "state", "failures", "refused"])

    return calls.select("key", "ord", F.col("ts").cast("double").alias("ts"), "ok").groupBy("key").applyInPandas(f, "key string, ord bigint, state string, failures bigint, refused boolean")


def playbook_runs(incidents: DataFrame, playbooks: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """The playbook of highest priority for each incident (id, key, type, severity, ts ms), and whether it runs.

    A playbook (name, type, min_severity, cooldown_ms, priority) whose condition on the incident fails is passed over; it
    runs again for a key once its cooldown has passed since its last run. Incidents after a pause of a whole cooldown
    run in any case, so runs are followed only between such pauses.
    """
    level = lambda c: F.array_position(F.array(*map(F.lit, ("info", "warning", "error", "critical"))), F.col(c))
    j = incidents.join(broadcast_if_few(playbooks), "type").filter(level("severity") >= level("min_severity"))
    for name, holds in (conditions or {}).items():
        j = j.filter((F.col("name") != name) | F.coalesce(holds, F.lit(False)))
    j = j.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("priority"), "name"))).filter("nth = 1").drop("nth")
    order = Window.partitionBy("key", "name").orderBy("ts", "id")
    since = F.col("ts") - F.lag("ts").over(order)
    j = j.withColumn("_paused", F.when(since.isNull() | (since >= F.col("cooldown_ms")), 1).otherwise(0)).withColumn("_burst", F.sum("_paused").over(order))
    bursts = j.groupBy("key", "name", "_burst").agg(F.array_sort(F.collect_list(F.struct("ts", *[c for c in j.columns if c not in ("ts", "key", "name", "_burst", "_paused")]))).alias("rows"))
    blank = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<boolean>").alias("runs"))

    def follow(a, x):
        runs = a["last"].isNull() | (x["ts"] - a["last"] >= x["cooldown_ms"])
        return F.struct(F.when(runs, x["ts"]).otherwise(a["last"]).cast("long").alias("last"), F.concat(a["runs"], F.array(runs)).alias("runs"))

    bursts = bursts.withColumn("_runs", F.aggregate("rows", blank, follow, lambda a: a["runs"]))
    out = bursts.select("key", "name", F.explode(F.arrays_zip("rows", "_runs")).alias("x"))
    return out.select("key", "name", "x.rows.*", F.col("x._runs").alias("runs"))


def restart_delay(attempt: Column, initial: float = 500, most: float = 30_000) -> Column:
    """Delay before a restart, null when the attempts are used up."""
    return F.when(attempt < RESTARTS, F.least(F.lit(most), initial * F.pow(F.lit(2.0), attempt)))
