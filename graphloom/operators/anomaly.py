"""Anomaly rules over nodes and edges, their deduplication, ranking, health score and quick fixes.

A finding is (graph_id, type, category, severity, node_ids, edge_ids, value, threshold, title). ``as_of`` stands for the
clock. Rules are total: they never fail on missing values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import js_round
from graphloom.operators import paths, traverse
from graphloom.operators.analytics import outliers
from graphloom.schema import GraphFrames


@dataclass(frozen=True)
class Limits:
    """Default thresholds."""

    retries: int = 3
    repairs: int = 2
    tokens: float = 50_000
    sigma: float = 2.5
    cognitive: float = 0.7
    latency_ms: float = 30_000
    edge_latency_ms: float = 5_000
    path_share: float = 0.35
    lease_ms: float = 600_000
    samples: int = 3


SEVERITIES = ("critical", "error", "warning", "info")


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _finding(df: DataFrame, type_: str, category: str, severity: Column, value: Column, threshold: Column, nodes: Column | None = None, edges: Column | None = None) -> DataFrame:
    return df.select(
        "graph_id", F.lit(type_).alias("type"), F.lit(category).alias("category"), severity.alias("severity"),
        F.array_sort(nodes if nodes is not None else _none()).alias("node_ids"), F.array_sort(edges if edges is not None else _none()).alias("edge_ids"),
        value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), F.lit(type_.replace("_", " ")).alias("title"),
    )


def _me() -> Column:
    return F.array("id")


def retry_loops(g: GraphFrames, x: Limits) -> DataFrame:
    """Any retries or repair rounds warn; at a limit they are errors; at twice a limit, or two of both, critical.

    Events of a node that are rejected, or are rejections or repairs, count as retries and as repair rounds.
    """
    told = lambda e: (e["status"] == "rejected") | e["type"].isin("rejection", "repair")
    rejected = F.coalesce(F.size(F.filter("provenance", lambda e: F.coalesce(told(e), e["type"].isin("rejection", "repair"), F.lit(False)))), F.lit(0))
    attempts = F.coalesce(F.array_max(F.transform("provenance", lambda e: e["attempt"])) - 1, F.lit(0))
    tries = F.greatest(F.coalesce(M.m["retries"], F.lit(0.0)), rejected.cast("double"), attempts.cast("double"))
    rounds = F.greatest(F.coalesce(M.m["repair_rounds"], M.meta("repairRounds", "double"), F.lit(0.0)), rejected.cast("double"))
    n = g.nodes.select("graph_id", "id", tries.alias("tries"), rounds.alias("rounds")).filter("tries > 0 or rounds > 0")
    excess = (F.col("tries") >= x.retries) | (F.col("rounds") >= x.repairs)
    twice = (F.col("tries") >= 2 * x.retries) | (F.col("rounds") >= 2 * x.repairs) | ((F.col("tries") >= 2) & (F.col("rounds") >= 2))
    severity = F.when(excess & twice, "critical").when(excess, "error").otherwise("warning")
    value = F.when(excess, F.col("tries") + F.col("rounds")).otherwise(F.col("tries"))
    return _finding(n, "runaway_retry_loop", "execution", severity, value, F.lit(x.retries), _me())


def rejection_loops(g: GraphFrames, x: Limits) -> DataFrame:
    """Loop, pushback and cycle edges that carry as many rejections or repairs as repair rounds are allowed."""
    n = F.coalesce(F.size(F.filter("exchanges", lambda e: e["type"].isin("rejection", "repair") | (e["verdict"] == "FAIL"))), F.lit(0))
    e = g.edges.filter(F.col("kind").isin("loop", "pushback") | F.coalesce("is_cycle", F.lit(False))).select("graph_id", "id", "source", "target", n.alias("n")).filter(F.col("n") >= x.repairs)
    return _finding(e, "runaway_retry_loop", "execution", F.when(F.col("n") >= 2 * x.repairs, "critical").otherwise("error"), F.col("n"), F.lit(x.repairs), F.array("source", "target"), _me())


def token_spikes(g: GraphFrames, x: Limits) -> DataFrame:
    """Too many tokens outright, or above both the mean by deviations and twice the mean."""
    w = Window.partitionBy("graph_id")
    n = g.nodes.select("graph_id", "id", M.TOKENS["tok_anomaly"].alias("tok")).filter("tok > 0")
    n = n.withColumns({"mean": F.avg("tok").over(w), "dev": F.stddev_pop("tok").over(w), "k": F.count("tok").over(w)})
    limit = F.col("mean") + x.sigma * F.col("dev")
    odd = (F.col("k") >= x.samples) & (F.col("tok") >= limit) & (F.col("tok") > 2 * F.col("mean"))
    n = n.withColumn("odd", odd).filter(F.col("odd") | (F.col("tok") >= x.tokens))
    severe = (F.col("tok") >= 2 * x.tokens) | (F.col("tok") >= 4 * F.col("mean"))
    return _finding(n, "cognitive_token_spike", "resource", F.when(severe, "critical").otherwise("error"), F.col("tok"), js_round(F.when(F.col("odd"), limit).otherwise(F.lit(x.tokens))), _me())


def reasoning_share(g: GraphFrames, x: Limits) -> DataFrame:
    """More than 10 000 reasoning tokens that are most of a node's; from 85 %, or 40 000, critical."""
    n = g.nodes.select("graph_id", "id", M.REASONING.alias("r"), M.TOKENS["tok_anomaly"].alias("tok")).filter(f"r > 10000 and try_divide(r, tok) >= {x.cognitive}")
    severe = (F.try_divide("r", "tok") >= 0.85) | (F.col("r") >= 40_000)
    return _finding(n, "cognitive_token_spike", "resource", F.when(severe, "critical").otherwise("error"), F.col("r"), js_round(F.col("tok") * x.cognitive), _me())


def unbounded_growth(g: GraphFrames, x: Limits, factor: float = 3, least: float = 25_000) -> DataFrame:
    """Tokens at least three times those of the step before, and 25 000; reported against twice those."""
    w = Window.partitionBy("graph_id").orderBy("step", "ord")
    n = g.nodes.select("graph_id", "id", "step", "ord", M.TOKENS["tok_anomaly"].alias("tok")).filter("step is not null and tok > 0")
    n = n.withColumns({"before": F.lag("tok").over(w), "from": F.lag("id").over(w)}).filter((F.col("tok") >= factor * F.col("before")) & (F.col("tok") >= least))
    return _finding(n, "unbounded_growth", "resource", F.lit("warning"), F.col("tok"), F.col("before") * 2, F.array("from", "id"))


def stranded_locks(g: GraphFrames, x: Limits, as_of: Column) -> DataFrame:
    """Leases on running nodes past their end or the time limit (critical where pending nodes wait), leases kept by
    failed and skipped nodes, and running leases over 80 % of the limit."""
    token, agent = M.meta("leaseToken", "string"), M.meta("leaseAgent", "string")
    until = F.unix_millis(F.try_to_timestamp(F.coalesce(M.meta("leaseExpiresAt", "string"), M.meta("expiresAt", "string"))))
    n = g.nodes.select("graph_id", "id", "status", token.alias("token"), agent.alias("agent"), until.alias("until"), F.unix_millis(as_of).alias("now"), F.greatest(M.DURATIONS["dur_lock"], F.lit(0.0)).alias("ms"))
    waits = g.edges.select("graph_id", F.col("source").alias("id"), F.col("target").alias("t")).join(g.nodes.filter("status = 'pending'").select("graph_id", F.col("id").alias("t")), ["graph_id", "t"]).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("waiting"))
    n = n.join(waits, ["graph_id", "id"], "left").filter("token is not null or agent is not null or until is not null")
    running, over = F.col("status") == "running", (F.col("ms") > x.lease_ms) | F.coalesce(F.col("until") < F.col("now"), F.lit(False))
    late = n.filter(running & over)
    zombie = n.filter(F.col("status").isin("error", "skipped") & F.col("token").isNotNull())
    near = n.filter(running & ~over & (F.col("ms") > 0.8 * x.lease_ms))
    kind = "stranded_distributed_lock"
    return (
        _finding(late, kind, "execution", F.when(F.col("waiting") > 0, "critical").otherwise("error"), F.col("ms"), F.lit(x.lease_ms), _me())
        .unionByName(_finding(zombie, "zombie_lease", "execution", F.lit("error"), F.lit(1), F.lit(0), _me()))
        .unionByName(_finding(near, kind, "execution", F.lit("warning"), F.col("ms"), F.lit(x.lease_ms), _me()))
    )


def lost_edges(g: GraphFrames, x: Limits) -> DataFrame:
    """Edges with an end that is no node."""
    return _finding(traverse.dangling_edges(g), "contract_violation", "topology", F.lit("error"), F.lit(1), F.lit(0), None, _me())


def deadlocked_rings(g: GraphFrames, x: Limits) -> DataFrame:
    """Cycles: a warning if an edge inside declares the loop and no node is stuck, else critical."""
    rings = paths.cycles(g)
    ring = rings.select("graph_id", "nth", F.explode("ids").alias("id"))
    declared = g.edges.filter("kind = 'loop' or is_cycle").select("graph_id", "source", "target")
    inside = ring.withColumnRenamed("id", "source").join(declared, ["graph_id", "source"]).join(ring.withColumnRenamed("id", "target"), ["graph_id", "nth", "target"])
    stuck = ring.join(g.nodes.filter("status in ('pending', 'running')").select("graph_id", "id"), ["graph_id", "id"], "left_semi")
    rings = rings.join(inside.select("graph_id", "nth", F.lit(True).alias("declared")).distinct(), ["graph_id", "nth"], "left").join(stuck.select("graph_id", "nth", F.lit(True).alias("stuck")).distinct(), ["graph_id", "nth"], "left")
    return _finding(rings, "circular_dependency_deadlock", "topology", F.when(F.col("declared") & F.col("stuck").isNull(), "warning").otherwise("critical"), F.size("ids"), F.lit(0), F.col("ids"))


def deadlocked_joins(g: GraphFrames, x: Limits) -> DataFrame:
    """Waiting nodes of several ways in, or of kind join, some of which come from failed or skipped nodes."""
    e = g.valid_edges().join(g.nodes.select("graph_id", F.col("id").alias("source"), F.col("status").alias("up")), ["graph_id", "source"])
    joins = e.groupBy("graph_id", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("ways"), F.count_if(F.col("up").isin("error", "skipped")).alias("lost"), F.array_sort(F.collect_set("source")).alias("from"))
    joins = joins.join(g.nodes.filter("status = 'pending' or status is null").select("graph_id", "id", "kind"), ["graph_id", "id"]).filter("(ways > 1 or kind = 'join') and lost > 0")
    return _finding(joins, "diamond_join_deadlock", "topology", F.lit("critical"), F.col("lost"), F.lit(0), F.concat(_me(), F.col("from")))


def orphaned_subgraphs(g: GraphFrames, x: Limits) -> DataFrame:
    """Nodes without a way in that the graph's first node doesn't reach, in graphs of more than two nodes."""
    first = g.nodes.groupBy("graph_id").agg(F.min_by("id", "ord").alias("id"), F.count(F.lit(1)).alias("size")).filter("size > 2")
    # Nothing reaches a node without a way in, but the start itself: no search is needed.
    has_in = g.edges.select("graph_id", F.col("target").alias("id")).distinct()
    alone = g.nodes.select("graph_id", "id").join(first.select("graph_id"), "graph_id", "left_semi").join(has_in, ["graph_id", "id"], "left_anti")
    return _finding(alone.join(first, ["graph_id", "id"], "left_anti"), "orphaned_subgraph", "topology", F.lit("warning"), F.lit(0), F.lit(1), _me())


def structure(g: GraphFrames, x: Limits) -> DataFrame:
    """Dangling edges, cycles, joins that can't happen, nodes that nothing leads to."""
    return reduce(DataFrame.unionByName, (rule(g, x) for rule in (lost_edges, deadlocked_rings, deadlocked_joins, orphaned_subgraphs)))


def latency(g: GraphFrames, x: Limits, with_path: bool = True, duration: str = "dur_anomaly") -> DataFrame:
    """Hogs of the critical path (10 s and 35 % of it), stalls in thought (15 s and 75 %), hanging commands, slow edges,
    and outliers among the nodes that none of these names. ``duration``: which of the named durations counts."""
    t = F.coalesce(M.m["timing_breakdown"], M.m["timing"])
    n = g.nodes.select("graph_id", "id", M.DURATIONS[duration].alias("ms"), F.coalesce(t["think"], t["cognitive"]).alias("think"), "commands")
    kind = "latency_bottleneck"
    stall = n.filter("think > 15000 and try_divide(think, ms) >= 0.75")
    out = _finding(stall, kind, "performance", F.when(F.col("think") >= 45_000, "critical").otherwise("warning"), F.col("think"), F.lit(15_000), _me())
    hang = n.withColumn("slow", F.array_max(F.transform("commands", lambda c: c["duration_ms"]))).filter(f"slow >= {x.latency_ms}")
    out = out.unionByName(_finding(hang, kind, "performance", F.when(F.col("slow") >= 60_000, "critical").otherwise("error"), F.col("slow"), F.lit(x.latency_ms), _me()))
    if with_path:
        hog = paths.critical_path(g, "anomaly", duration).filter((F.col("share") >= 100 * x.path_share) & (F.col("ms") >= 10_000))
        severe = (F.col("ms") >= 60_000) | (F.col("share") >= 60)
        out = out.unionByName(_finding(hog, kind, "performance", F.when(severe, "critical").otherwise("error"), F.col("ms"), js_round(F.col("ms") / F.col("share") * 100 * x.path_share), _me()))
    named = out.select("graph_id", F.explode("node_ids").alias("id")).distinct()
    odd = outliers(g, x.sigma, x.samples, duration).filter(F.col("ms") >= x.latency_ms).join(named, ["graph_id", "id"], "left_anti")
    out = out.unionByName(_finding(odd, kind, "performance", F.when(F.col("ms") >= 2 * x.latency_ms, "critical").otherwise("error"), F.col("ms"), js_round(F.col("mean") + x.sigma * F.col("deviation")), _me()))
    slow = g.edges.select("graph_id", "id", F.col("traffic.avg_latency_ms").alias("ms")).filter(F.col("ms") >= x.edge_latency_ms)
    return out.unionByName(_finding(slow, kind, "performance", F.when(F.col("ms") >= 2 * x.edge_latency_ms, "error").otherwise("warning"), F.col("ms"), F.lit(x.edge_latency_ms), None, _me()))


def error_cascades(g: GraphFrames, x: Limits) -> DataFrame:
    """What lies downstream of each failed node: critical from three nodes or 35 % of the graph."""
    roots = g.nodes.filter("status = 'error'").select("graph_id", F.col("id").alias("root"))
    reach = traverse.bfs(traverse.arcs(g), roots).filter("depth > 0").groupBy("graph_id", "root").agg(F.count(F.lit(1)).alias("hit"), F.collect_set("id").alias("below"))
    reach = reach.join(g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")), "graph_id")
    severe = (F.col("hit") >= 3) | (F.col("hit") / F.col("size") >= 0.35)
    return _finding(reach, "error_cascade", "quality", F.when(severe, "critical").otherwise("error"), F.col("hit"), F.lit(3), F.concat(F.array("root"), F.col("below")))


def contract_violations(g: GraphFrames, x: Limits) -> DataFrame:
    """Success declared over failed commands, or over open critical findings."""
    ok = g.nodes.filter("status = 'success'")
    failed = F.coalesce(F.size(F.filter("commands", lambda c: c["exit_code"] != 0)), F.lit(0))
    open_ = F.coalesce(F.size(F.filter("findings", lambda f: (f["severity"] == "critical") & (f["status"] == "open"))), F.lit(0))
    a, b = ok.withColumn("k", failed).filter("k > 0"), ok.withColumn("k", open_).filter("k > 0")
    say = lambda d, title: _finding(d, "contract_violation", "quality", F.lit("critical"), F.col("k"), F.lit(0), _me()).withColumn("title", F.lit(title))
    return say(a, "success with failed commands").unionByName(say(b, "success with open critical findings"))


RULES = (retry_loops, rejection_loops, token_spikes, reasoning_share, unbounded_growth, structure, latency, error_cascades, contract_violations)


def detect(g: GraphFrames, as_of: Column | None = None, limits: Limits = Limits(), rules=RULES, types: list[str] | None = None) -> DataFrame:
    """All findings: one of each type, nodes and title; ranked by severity, then value."""
    parts = [rule(g, limits) for rule in rules]
    if as_of is not None:
        parts.append(stranded_locks(g, limits, as_of))
    all_ = reduce(lambda a, b: a.unionByName(b), parts)
    all_ = all_.filter(F.col("type").isin(types)) if types else all_
    all_ = all_.withColumn("rank", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))
    same = Window.partitionBy("graph_id", "type", "node_ids", "title").orderBy("rank", F.desc("value"), "edge_ids")
    once = all_.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")
    order = Window.partitionBy("graph_id").orderBy("rank", F.desc("value"), "type", "node_ids", "edge_ids")
    return once.withColumn("place", F.row_number().over(order)).drop("rank")


def health(g: GraphFrames, findings: DataFrame) -> DataFrame:
    """Counts by severity and 100 less 35, 18, 8 and 2 for each, never under 0; graphs without findings have 100."""
    n = {s: F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES}
    by = findings.groupBy("graph_id").agg(*n.values())
    out = g.nodes.select("graph_id").distinct().join(by, "graph_id", "left").fillna(0, list(SEVERITIES))
    score = 100 - 35 * F.col("critical") - 18 * F.col("error") - 8 * F.col("warning") - 2 * F.col("info")
    return out.withColumn("health", F.greatest(F.lit(0), score))


def about(findings: DataFrame, node: str | None = None, edge: str | None = None) -> DataFrame:
    return findings.filter(F.array_contains("node_ids", node) if node is not None else F.array_contains("edge_ids", edge))


def summary_text(findings: DataFrame, top: int = 5) -> str:
    """A short text of the first findings; a report, so only a few rows reach the driver."""
    rows = findings.orderBy("place").limit(top).collect()
    return "\n".join(f"[{r.severity}] {r.title}: {', '.join(r.node_ids or r.edge_ids)} ({r.value:g} against {r.threshold:g})" for r in rows) or "no anomalies"


def quick_fix(g: GraphFrames, action: str, graph_id: str, target: str) -> GraphFrames:
    """The graph after break_cycle or bypass_join (an edge goes), reset_retries, evict_lease or prune_context (of a node)."""
    here = (F.col("graph_id") == graph_id) & (F.col("id") == target)
    if action in ("break_cycle", "bypass_join"):
        return GraphFrames(g.nodes, g.edges.filter(~here), g.sections)
    if action == "reset_retries":
        changed = m_with({"retries": F.lit(0.0), "repair_rounds": F.lit(0.0)})
        nodes = g.nodes.withColumn("metrics", F.when(here, changed).otherwise(F.col("metrics"))).withColumn("status", F.when(here, F.lit("pending")).otherwise(F.col("status")))
    elif action == "evict_lease":
        kept = F.to_json(F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, _: ~F.startswith(k, F.lit("lease"))))
        nodes = g.nodes.withColumn("metadata", F.when(here, kept).otherwise(F.col("metadata"))).withColumn("status", F.when(here, F.lit("pending")).otherwise(F.col("status")))
    elif action == "prune_context":
        changed = m_with({"tokens_in": js_round(M.m["tokens_in"] * 0.5)})
        nodes = g.nodes.withColumn("metrics", F.when(here, changed).otherwise(F.col("metrics"))).withColumn("context", F.when(here, F.lit(None)).otherwise(F.col("context")))
    else:
        return g
    return GraphFrames(nodes, g.edges, g.sections)


def m_with(values: dict[str, Column]) -> Column:
    out = F.col("metrics")
    for k, v in values.items():
        out = out.withField(k, v)
    return out
