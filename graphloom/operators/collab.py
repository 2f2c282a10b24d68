"""Collaboration: event feeds, lock arbitration, presence, proximity of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priority of roles in arbitration; others have none.
ROLE_PRIORITY = {"orchestrator": 5, "validator": 4, "critic": 3, "implementer": 2, "user": 1, "system": 1}


def priority(role: Column) -> Column:
    role, out = F.lower(role), None
    for name, p in ROLE_PRIORITY.items():
        out = F.when(role == name, F.lit(p)) if out is None else out.when(role == name, F.lit(p))
    return out.otherwise(F.lit(0))


def arbitrate(requests: DataFrame, strategy: str = "priority") -> DataFrame:
    """The winner of each resource among requests (resource, agent_id, role, at): others wait.

    ``priority``: role, then the earliest; ``timestamp``: the latest, then role; ``first``: the earliest, then role;
    ``optimistic``: all win. Final ties go by agent id.
    """
    p = priority(F.col("role"))
    order = {"priority": (F.desc(p), F.asc("at")), "timestamp": (F.desc("at"), F.desc(p)), "first": (F.asc("at"), F.desc(p)), "optimistic": (F.asc("at"), F.desc(p))}[strategy]
    nth = F.row_number().over(Window.partitionBy("resource").orderBy(*order, "agent_id"))
    return requests.withColumn("nth", nth).withColumn("granted", F.lit(True) if strategy == "optimistic" else F.col("nth") == 1).drop("nth")


def may_write(locks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests (resource, agent_id) against held locks (resource, holder, expires): free, own and expired ones pass."""
    j = requests.join(locks, "resource", "left")
    return j.withColumn("allowed", F.col("holder").isNull() | (F.col("holder") == F.col("agent_id")) | (F.col("expires") <= now))


def presence(agents: DataFrame, now: Column, heartbeat_ms: int = 5000, disconnect_ms: int = 30_000, idle_ms: int = 15_000) -> DataFrame:
    """State of agents (agent_id, last_seen ms, is_busy): removed, disconnected, idle or online."""
    age = now - F.col("last_seen")
    state = F.when(age >= 2 * max(disconnect_ms, heartbeat_ms), "removed").when(age >= disconnect_ms, "disconnected").when((age >= idle_ms) & ~F.col("is_busy"), "idle").otherwise("online")
    return agents.withColumn("age_ms", age).withColumn("presence", state)


def near_pairs(points: DataFrame, radius: float, group: str = "graph_id") -> DataFrame:
    """Pairs of points (group, id, x, y) within ``radius``; under half of it they are critical.

    Points meet only in their own and adjoining cells of a grid as wide as the radius. Both sides shuffle: compressed files
    of points are many times smaller than what a broadcast of them holds on the driver.
    """
    p = points.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = p.select(group, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", around.alias("o"))
    a = a.select(group, "a", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    b = p.select(group, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    out = a.join(b.hint("merge"), [group, "cx", "cy"]).filter("a < b").withColumn("distance", d).filter(F.col("distance") <= radius)
    return out.select(group, "a", "b", "distance", (F.col("distance") < 0.5 * radius).alias("is_critical"))


def overlaps(boxes: DataFrame, cell: float = 200, group: str = "graph_id") -> DataFrame:
    """Pairs of boxes (group, id, x, y, width, height) whose insides meet, by the grid cells they cover."""
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
    b = boxes.select("*", F.explode(span("x", "width")).alias("cx")).select("*", F.explode(span("y", "height")).alias("cy"))
    side = lambda s: b.select(group, "cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y", "width", "height")])
    j = side("a").join(side("b"), [group, "cx", "cy"]).filter("a_id < b_id and a_x < b_x + b_width and b_x < a_x + a_width and a_y < b_y + b_height and b_y < a_y + a_height")
    return j.select(group, F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def in_frustum(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def feed_fold(events: DataFrame) -> DataFrame:
    """Per agent of a feed (agent_id, type, ts, resource): last event, counts by kind; reject counts as error."""
    kind = F.when(F.col("type") == "reject", F.lit("error")).otherwise(F.col("type"))
    e = events.withColumn("type", kind)
    return e.groupBy("agent_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"), F.max_by("type", "ts").alias("last_type"), F.count_if(F.col("type") == "error").alias("errors"), F.count_if(F.col("type") == "handoff").alias("handoffs"))


def locks_held(events: DataFrame) -> DataFrame:
    """Locks after a feed: the last of acquire and release decides."""
    e = events.filter(F.col("type").isin("lock-acquired", "lock-released"))
    last = e.groupBy("resource").agg(F.max_by(F.struct("type", "agent_id"), "ts").alias("x"))
    return last.filter("x.type = 'lock-acquired'").select("resource", F.col("x.agent_id").alias("holder"))
