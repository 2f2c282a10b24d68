"""Event-sourced replay: the state after any event of a log, differences between two such states, bookmarks, incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.diff import full_diff

# The verbs of the log by what they do to a task.
CREATE = ("plan-task-added", "task-added")
CLAIM = ("task-claimed", "task:claim")
RUN = ("task-submitted", "validation-started", "task:submit")
FAIL = ("task-rejected", "task:reject", "validation-failed", "gate:fail")
PASS = ("task-finished", "tasks-completed", "task:success", "review-recorded")
REMOVE = ("task-removed", "node-removed", "task:delete", "task-pruned")
EDGE_REMOVE = ("edge-removed", "edge:delete")
ALIASES = {"done": "success", "completed": "success", "passed": "success", "failed": "error", "rejected": "error", "in_progress": "running", "claimed": "running", "submitted": "running", "open": "pending", "ready": "pending"}


def operations(log: DataFrame) -> DataFrame:
    """Each event as operations on entities, in order: log_id, id, seq (event, part), op, status, kind, lease, events' index.

    A projection's tasks and graph nodes come before the verb of their event. Operations: ``task`` (of a projection),
    ``node`` (of a projection's graph), ``create``, ``claim``, ``run``, ``fail``, ``pass`` and ``remove``.
    """
    payload = lambda c: F.nullif(F.get_json_object("payload", f"$.{c}"), F.lit(""))
    shape = "tasks array<struct<id:string,status:string,lease:string>>, graph struct<nodes:array<struct<id:string,status:string,kind:string>>, edges:array<struct<source:string,target:string>>>"
    e = log.select("log_id", "event_index", F.col("kind").alias("verb"), "actor", "payload", F.from_json(F.coalesce("projection", F.lit("{}")), shape).alias("p"))
    given = lambda c: F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("pending")))
    same = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    status = lambda c: F.coalesce(F.try_element_at(same, given(c)), given(c))
    part = lambda op, id_, s, kind, lease, nth, step: F.struct(F.lit(nth).alias("part"), step.alias("step"), F.lit(op).alias("op"), id_.alias("id"), s.alias("status"), kind.alias("kind"), lease.alias("lease"))
    none = F.lit(None).cast("string")
    no_step = F.lit(None).cast("int")
    tasks = F.transform("p.tasks", lambda t, i: part("task", t["id"], status(t["status"]), none, F.nullif(t["lease"], F.lit("")), 0, i + 1))
    nodes = F.transform("p.graph.nodes", lambda n, i: part("node", n["id"], status(n["status"]), F.coalesce(n["kind"], F.lit("agent")), none, 1, i))
    passes = (F.col("verb") != "review-recorded") | ~F.coalesce(F.lower(F.get_json_object("payload", "$.passed")), F.lit("false")).isin("false", "null", "0", "")
    verb = F.when(F.col("verb").isin(*CREATE), "create").when(F.col("verb").isin(*CLAIM), "claim").when(F.col("verb").isin(*RUN), "run").when(F.col("verb").isin(*FAIL), "fail").when(F.col("verb").isin(*PASS) & passes, "pass").when(F.col("verb").isin(*REMOVE), "remove")
    becomes = F.when(verb == "create", "pending").when(verb.isin("claim", "run"), "running").when(verb == "fail", "error").when(verb == "pass", "success")
    lease = F.when(verb == "claim", F.coalesce(F.nullif("actor", F.lit("")), payload("agent"), F.lit("")))
    own = F.struct(F.lit(2).alias("part"), no_step.alias("step"), verb.alias("op"), F.coalesce(payload("task_id"), payload("id")).alias("id"), becomes.alias("status"), none.alias("kind"), lease.alias("lease"))
    empty = F.array().cast("array<struct<part:int,step:int,op:string,id:string,status:string,kind:string,lease:string>>")
    every = F.concat(F.coalesce(tasks, empty), F.coalesce(nodes, empty), F.array(own))
    out = e.select("log_id", "event_index", F.posexplode(every).alias("nth", "o")).filter("o.op is not null and nullif(o.id, '') is not null")
    return out.select("log_id", "o.id", F.struct("event_index", "nth").alias("seq"), "event_index", "o.op", "o.status", "o.kind", "o.lease", "o.step")


def _present(ops: DataFrame, block: int) -> DataFrame:
    """Whether an operation's entity is a task, and a node, before it.

    The last operation before that founds or removes it decides. It is looked for in the operation's own block of events, and
    else in the last of the blocks before that has one, so an entity of many events is spread over many tasks.
    """
    o = ops.withColumn("block", F.floor(F.col("event_index") / block))
    task = F.when(F.col("op").isin("task", "create", "claim"), True).when(F.col("op") == "remove", False)
    node = F.when(F.col("op").isin("task", "node", "create"), True).when(F.col("op") == "remove", False)
    o = o.withColumns({"task_set": task, "node_set": node})
    key = ["log_id", "id", "block"]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    ends = o.groupBy(*key).agg(last("task_set"), last("node_set"))
    ahead = Window.partitionBy("log_id", "id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, *[F.last(f"{c}_set", ignorenulls=True).over(ahead).alias(f"{c}_before") for c in ("task", "node")])
    inside = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    was = lambda c: F.coalesce(F.last(f"{c}_set", ignorenulls=True).over(inside), f"{c}_before", F.lit(False)).alias(f"was_{c}")
    return o.join(ends, key).select(*ops.columns, was("task"), was("node"))


def state_at(log: DataFrame, index: int | Column, block: int = 10_000) -> DataFrame:
    """Tasks and nodes (log_id, id, status, lease, is_failed, node_kind) after the events up to ``index``.

    Each operation sets or clears one entity's fields, some only where the entity is a task or a node already. Once that is
    known, a field is what the last operation that touches it made of it: a maximum by order, which any parts of a log give in
    any grouping. No log, and no entity, is folded in one task.
    """
    o = _present(operations(log.filter(F.col("event_index") <= index)), block)
    op, task, node = F.col("op"), F.col("was_task"), F.col("was_node")
    later = op.isin("run", "fail", "pass")
    removed = op == "remove"
    touches = {
        "task": op.isin("task", "create", "claim", "remove") | later & task,
        "node": op.isin("task", "create", "remove") | (op == "node") & ~node | (op == "claim") & node | later & task & node,
        "kind": op.isin("create", "remove") | op.isin("task", "node") & ~node,
        "lease": op.isin("claim", "pass", "remove") | (op == "task") & (F.col("lease").isNotNull() | F.col("status").isin("success", "cached")),
        "failed": op.isin("fail", "pass", "remove") | (op == "task") & F.col("status").isin("error", "success"),
    }
    values = {
        "task": F.when(~removed, F.col("status")), "node": F.when(~removed, F.col("status")), "kind": F.when(~removed, F.coalesce("kind", F.lit("agent"))),
        "lease": F.when(op.isin("claim", "task"), F.col("lease")), "failed": (op == "fail") | (op == "task") & (F.col("status") == "error"),
    }
    # A value may be null (cleared), so it is kept in a struct beside its order.
    last = [F.max(F.when(touches[c], F.struct("seq", values[c].cast("string").alias("value"))))["value"].alias(c) for c in touches]
    s = o.groupBy("log_id", "id").agg(*last).filter("task is not null or node is not null")
    return s.select("log_id", "id", F.coalesce("task", "node").alias("status"), "lease", F.coalesce(F.col("failed") == "true", F.lit(False)).alias("is_failed"), F.when(F.col("node").isNotNull(), F.col("kind")).alias("node_kind"))


def edges_at(log: DataFrame, index: int | Column) -> DataFrame:
    """Edges (log_id, source, target) after the events up to ``index``: added since their removal and that of their ends."""
    e = log.filter(F.col("event_index") <= index)
    shape = "graph struct<edges:array<struct<source:string,target:string>>>"
    added = e.select("log_id", "event_index", F.explode(F.from_json("projection", shape)["graph"]["edges"]).alias("x"))
    added = added.groupBy("log_id", "x.source", "x.target").agg(F.max("event_index").alias("added"))
    own = lambda c: F.nullif(F.get_json_object("payload", f"$.{c}"), F.lit(""))
    gone = e.filter(F.col("kind").isin(*EDGE_REMOVE)).groupBy("log_id", F.coalesce(own("edge_id"), own("id")).alias("edge")).agg(F.max("event_index").alias("gone"))
    ends = e.filter(F.col("kind").isin(*REMOVE)).groupBy("log_id", F.coalesce(own("task_id"), own("id")).alias("end")).agg(F.max("event_index").alias("gone"))
    a = added.withColumn("edge", F.concat("source", F.lit("->"), "target")).join(gone.withColumnRenamed("gone", "edge_gone"), ["log_id", "edge"], "left")
    for c in ("source", "target"):
        a = a.join(ends.select("log_id", F.col("end").alias(c), F.col("gone").alias(f"{c}_gone")), ["log_id", c], "left")
    # Within an event the projection comes first, so a removal of the same event holds.
    stays = F.col("added") > F.coalesce(F.greatest("edge_gone", "source_gone", "target_gone"), F.lit(-1))
    return a.filter(stays).select("log_id", "source", "target")


def status_at(log: DataFrame, index: int | Column) -> DataFrame:
    """Statuses alone, in SQL: the last verb that sets one, after the entity's last creation, unless it was removed since."""
    e = log.filter(F.col("event_index") <= index)
    task = F.coalesce(F.get_json_object("payload", "$.task_id"), F.get_json_object("payload", "$.id"))
    passed = (F.col("kind") != "review-recorded") | (F.get_json_object("payload", "$.passed") == "true")
    sets = F.when(F.col("kind").isin(*CREATE), "pending").when(F.col("kind").isin(*CLAIM, *RUN), "running").when(F.col("kind").isin(*FAIL), "error").when(F.col("kind").isin(*PASS) & passed, "success").when(F.col("kind").isin(*REMOVE), "removed")
    e = e.select("log_id", task.alias("id"), "event_index", sets.alias("status"), F.col("kind").isin(*CREATE, *CLAIM, *REMOVE).alias("founds")).filter("id is not null and status is not null")
    begun = F.bool_or("founds").over(Window.partitionBy("log_id", "id").orderBy("event_index"))
    last = e.withColumn("begun", begun).filter("begun").groupBy("log_id", "id").agg(F.max_by("status", "event_index").alias("status"))
    return last.filter("status <> 'removed'")


def state_diff(log: DataFrame, before: int | Column, after: int | Column) -> DataFrame:
    """What events ``before`` (exclusive) to ``after`` changed."""
    return full_diff(state_at(log, before), state_at(log, after), ["log_id", "id"], {"status": 0, "lease": 0, "is_failed": 0}).withColumnsRenamed({"base_status": "status_before", "comp_status": "status_after"})


def bookmarks(log: DataFrame) -> DataFrame:
    """Events worth a bookmark: failures before critics before milestones."""
    k = F.lower("kind")
    what = F.when(k.rlike("fail|reject|error"), "failure").when(k.rlike("critic|review"), "critic").when(k.rlike("compiled|finished|milestone|completed"), "milestone")
    return log.select("log_id", "event_index", "kind", what.alias("bookmark")).filter("bookmark is not null")


def as_of(events: DataFrame, probes: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """For each probe (key, ts) the value of the last event of its key at or before it: one sort, no theta join."""
    e = events.select(key, F.col(ts).alias("ts"), F.lit(0).alias("is_probe"), F.col(value).alias("value"))
    p = probes.select(key, F.col(ts).alias("ts"), F.lit(1).alias("is_probe"), F.lit(None).cast(events.schema[value].dataType).alias("value"))
    w = Window.partitionBy(key).orderBy("ts", "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(p).withColumn("as_of", F.last("value", ignorenulls=True).over(w))
    return both.filter("is_probe = 1").select(key, F.col("ts").alias(ts), "as_of")


def incident_checks(steps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations of a recorded incident: positions, time order, node ids, edge ends (incident_id, step, problem)."""
    w = Window.partitionBy("incident_id").orderBy("step", "ts")
    place = steps.withColumn("n", F.row_number().over(w) - 1).filter("n <> step").select("incident_id", "step", F.lit("step out of place").alias("problem"))
    back = steps.withColumn("before", F.lag("ts").over(w)).filter("ts < before").select("incident_id", "step", F.lit("time runs back").alias("problem"))
    twice = nodes.groupBy("incident_id", "step", "id").count().filter("count > 1 or coalesce(id, '') = ''").select("incident_id", "step", F.lit("node id not unique").alias("problem"))
    lost = None
    for end in ("source", "target"):
        x = edges.join(nodes.select("incident_id", "step", F.col("id").alias(end)), ["incident_id", "step", end], "left_anti").select("incident_id", "step", F.lit("dangling edge").alias("problem"))
        lost = x if lost is None else lost.unionByName(x)
    return place.unionByName(back).unionByName(twice).unionByName(lost)


def healthy_ratio(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("incident_id", "step").agg((F.count_if(F.col("status").isin("success", "running", "pending")) / F.count(F.lit(1))).alias("healthy"))


def buffer_at(chunks: DataFrame, t: float) -> DataFrame:
    """Terminal text (session_id, text) of all chunks up to ``t`` in order."""
    c = chunks.filter(F.col("ts") <= t).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "ord", "text"))).alias("c"))
    return c.select("session_id", F.array_join("c.text", "").alias("text"))


def trace_timing(chunks: DataFrame) -> DataFrame:
    """Time to the first chunk, gaps between chunks, bytes a second."""
    w = Window.partitionBy("session_id").orderBy("ts", "ord")
    c = chunks.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    out = c.groupBy("session_id").agg(F.min("ts").alias("first_ms"), F.avg("gap").alias("avg_gap_ms"), F.max("gap").alias("max_gap_ms"), F.sum("bytes").alias("bytes"), (F.max("ts") - F.min("ts")).alias("span_ms"))
    return out.withColumn("bytes_per_second", F.when(F.col("span_ms") > 0, F.col("bytes") / (F.col("span_ms") / 1000)).otherwise(0.0))
