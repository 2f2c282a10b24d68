"""Order-dependent graph algorithms, one graph a task: critical paths, schedules, cycles, strong components, rankings.

The four critical paths differ on purpose in which edges count and in how ties resolve.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions import metrics as M
from graphloom.runtime import prepare_python
from graphloom.schema import GraphFrames, fields


def per_graph(g: GraphFrames, f: Callable[[list[dict], list[dict]], list[tuple]], schema: str, duration: str = "dur_analytics") -> DataFrame:
    """Run ``f(nodes, edges)`` on each graph in input order; its rows get the graph_id in front."""
    prepare_python(g.nodes.sparkSession)
    n = g.nodes.select("graph_id", "ord", "id", "kind", "status", "section_id", M.DURATIONS[duration].alias("ms"), F.length(F.coalesce("name", "id")).alias("chars"))
    e = g.edges.select("graph_id", "ord", "id", "source", "target", "kind", F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"), F.coalesce("traffic.avg_latency_ms", F.lit(0.0)).alias("latency"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("min_len", F.lit(1)).alias("min_len"))
    return per_row(packed(n, e), f, schema)


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph: graph_id, nodes and edges as arrays of structs; graphs that have only one of them too."""
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    part = lambda x, name: x.select("graph_id", F.struct(*[c for c in x.columns if c != "graph_id"]).alias(name))
    # A few bytes of a graph may be seconds of work: the number of tasks is fixed, so that small tables spread too.
    both = part(nodes, "node").unionByName(part(edges, "edge"), allowMissingColumns=True).repartition(tasks, "graph_id")
    return both.groupBy("graph_id").agg(F.collect_list("node").alias("nodes"), F.collect_list("edge").alias("edges"))


def per_row(graphs: DataFrame, f: Callable[[list[dict], list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Run ``f(nodes, edges)`` on each packed graph; many small graphs share an Arrow batch, which ends by its bytes."""
    names = ["graph_id", *(x.split()[0] for x in schema.split(", "))]
    types = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(lo, 256).to_pylist():
                    parts = [sorted(r[c] or [], key=lambda x: (x["ord"] is None, x["ord"] or 0)) for c in ("nodes", "edges")]
                    for x in parts[0]:
                        if x.get("ms", 0) is None:
                            x["ms"] = math.nan
                    out += [(r["graph_id"], *row) for row in f(*parts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    wanted = fields("graph_id string, " + schema)
    types = [to_arrow_type(x.dataType) for x in wanted]
    return graphs.mapInArrow(run, wanted)


def successors(nodes: list[dict], edges: list[dict], loops: bool = True, cyclic: bool = True, distinct: bool = False) -> dict[str, list[str]]:
    ids = {n["id"] for n in nodes}
    out: dict[str, list[str]] = {n["id"]: [] for n in nodes}
    for e in edges:
        a, b = e["source"], e["target"]
        if a in ids and b in ids and (loops or a != b) and (cyclic or not e["is_cycle"]) and not (distinct and b in out[a]):
            out[a].append(b)
    return out


def kahn(next_: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Topological order, and the nodes that cycles keep out of it, in input order."""
    waiting = dict.fromkeys(next_, 0)
    for targets in next_.values():
        for t in targets:
            waiting[t] += 1
    queue, order = deque(v for v, k in waiting.items() if k == 0), []
    while queue:
        order.append(v := queue.popleft())
        for t in next_[v]:
            waiting[t] -= 1
            if waiting[t] == 0:
                queue.append(t)
    done = set(order)
    return order, [v for v in next_ if v not in done]


def topological_order(g: GraphFrames) -> DataFrame:
    """Place in a topological order; nodes on or behind cycles follow in input order, marked."""

    def f(nodes, edges):
        order, rest = kahn(successors(nodes, edges))
        return [(v, i, False) for i, v in enumerate(order)] + [(v, len(order) + i, True) for i, v in enumerate(rest)]

    return per_graph(g, f, "id string, place int, is_residual boolean")


def _relax(nodes: list[dict], next_: dict[str, list[str]], last_wins: bool) -> list[str]:
    """The heaviest path. ``last_wins``: equal lengths prefer more hops and later nodes; else the first found stays."""
    ms = {n["id"]: n["ms"] for n in nodes}
    order, rest = kahn(next_)
    best, hops, came = dict(ms), dict.fromkeys(ms, 1), dict.fromkeys(ms)
    for v in order + (rest if last_wins else []):
        for t in next_[v]:
            new = best[v] + ms[t]
            if new > best[t] or last_wins and new == best[t] and hops[v] + 1 >= hops[t]:
                best[t], hops[t], came[t] = new, hops[v] + 1, v
    top = None
    for v in best:
        if top is None or best[v] > best[top] or last_wins and best[v] == best[top] and hops[v] >= hops[top]:
            top = v
    path, seen = [], set()
    while top is not None and top not in seen:
        seen.add(top)
        path.append(top)
        top = came[top]
    return path[::-1]


def _from_roots(nodes: list[dict], next_: dict[str, list[str]]) -> list[str]:
    """The heaviest path by depth-first search with memory from the roots; a node on the stack ends its path."""
    ms = {n["id"]: n["ms"] for n in nodes}
    has_in = {t for targets in next_.values() for t in targets}
    memo: dict[str, tuple[float, str | None]] = {}
    active: set[str] = set()
    for root in [v for v in next_ if v not in has_in] or list(next_):
        stack = [(root, iter(next_[root]))] if root not in memo else []
        active.add(root)
        while stack:
            v, rest = stack[-1]
            t = next((t for t in rest if t not in memo and t not in active), None)
            if t is not None:
                active.add(t)
                stack.append((t, iter(next_[t])))
                continue
            stack.pop()
            active.discard(v)
            tail, to = 0.0, None
            for t in next_[v]:
                if t in memo and memo[t][0] > tail:
                    tail, to = memo[t][0], t
            memo[v] = (ms[v] + tail, to)
    top = None
    for v in next_:
        if v in memo and v not in has_in | set() and (top is None or memo[v][0] > memo[top][0]):
            top = v
    top = top if top is not None else max(memo, key=lambda v: memo[v][0], default=None)
    path = []
    while top is not None:
        path.append(top)
        top = memo[top][1]
    return path


def critical_path(g: GraphFrames, variant: str = "analytics", duration: str | None = None) -> DataFrame:
    """Nodes of the critical path with position, duration (the variant's own unless named), running sum and share.

    ``anomaly``: all edges, the first of equals. ``report``: from roots, without self-loops. ``analytics``: without edges
    marked as cycles; of equals more hops, then the later.
    """

    def f(nodes, edges):
        if not nodes:
            return []
        if variant == "report":
            path = _from_roots(nodes, successors(nodes, edges, loops=False))
        else:
            path = _relax(nodes, successors(nodes, edges, cyclic=variant == "anomaly"), variant == "analytics")
        ms, total, out = {n["id"]: n["ms"] for n in nodes}, 0.0, []
        whole = sum(ms[v] for v in path)
        for i, v in enumerate(path):
            total += ms[v]
            out.append((i, v, ms[v], total, ms[v] / whole * 100 if whole > 0 else 0.0))
        return out

    kind = {"anomaly": "dur_anomaly", "report": "dur_report", "analytics": "dur_analytics"}[variant]
    return per_graph(g, f, "position int, id string, ms double, running_ms double, share double", duration or kind)


def critical_ms(g: GraphFrames, variant: str = "analytics") -> DataFrame:
    return critical_path(g, variant).groupBy("graph_id").agg(F.sum("ms").alias("critical_ms"))


def schedule(g: GraphFrames) -> DataFrame:
    """Critical-path method: earliest and latest times, slack, bottleneck score; durations are 1 ms at least.

    Parallel edges count once, with the last one's latency. Edges that close a cycle are left out.
    """

    def f(nodes, edges):
        ids = {n["id"] for n in nodes}
        wait = {(e["source"], e["target"]): e["latency"] for e in edges if e["source"] in ids and e["target"] in ids and e["source"] != e["target"]}
        next_: dict[str, list[str]] = {n["id"]: [] for n in nodes}
        for a, b in wait:
            next_[a].append(b)
        order, rest = kahn(next_)
        order, place = order + rest, {v: i for i, v in enumerate(order + rest)}
        ms = {n["id"]: max(1.0, n["ms"]) for n in nodes}
        start = dict.fromkeys(ms, 0.0)
        for v in order:
            for t in next_[v]:
                if place[t] > place[v]:
                    start[t] = max(start[t], start[v] + ms[v] + wait[v, t])
        end = max((start[v] + ms[v] for v in ms), default=0.0)
        late = dict.fromkeys(ms, end)
        for v in reversed(order):
            for t in next_[v]:
                if place[t] > place[v]:
                    late[v] = min(late[v], late[t] - ms[t] - wait[v, t])
        slack = {v: late[v] - ms[v] - start[v] for v in ms}
        least, most_slack, most = min(slack.values(), default=0.0), max(slack.values(), default=0.0), max(ms.values(), default=1.0)
        degree = defaultdict(int)
        for a, b in wait:
            degree[a] += 1
            degree[b] += 1
        top = max(degree.values(), default=0)
        out = []
        for n in nodes:
            v = n["id"]
            tight = 1 - (slack[v] / most_slack if most_slack > 0 else 0.0)
            score = 0.6 * ms[v] / most + 0.3 * tight + 0.1 * (degree[v] / top if top else 0.0)
            critical = slack[v] <= max(1.0, least + 2)
            out.append((v, start[v], start[v] + ms[v], late[v] - ms[v], late[v], slack[v], critical, not critical and slack[v] <= 0.15 * end, score))
        return out

    return per_graph(g, f, "id string, early_start double, early_finish double, late_start double, late_finish double, slack double, is_critical boolean, is_near_critical boolean, bottleneck double", "dur_heatmap")


def tarjan(next_: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected components without recursion, each in the order it was found."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, on, out = [], set(), []
    for root in next_:
        if root in index:
            continue
        work = [(root, iter(next_[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            t = next(rest, None)
            if t is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        part.append(w := stack.pop())
                        on.discard(w)
                        if w == v:
                            break
                    out.append(part[::-1])
            elif t not in index:
                index[t] = low[t] = len(index)
                stack.append(t)
                on.add(t)
                work.append((t, iter(next_[t])))
            elif t in on:
                low[v] = min(low[v], index[t])
    return out


def strong_components(g: GraphFrames) -> DataFrame:
    """Every node's strong component by its smallest id, its size, and whether the node is on a cycle."""

    def f(nodes, edges):
        next_ = successors(nodes, edges)
        out = []
        for part in tarjan(next_):
            name = min(part)
            out += [(v, name, len(part), len(part) > 1 or v in next_[v]) for v in part]
        return out

    return per_graph(g, f, "id string, component string, size int, is_cyclic boolean")


def cycles(g: GraphFrames, variant: str = "back_edges") -> DataFrame:
    """One cycle per back edge of a depth-first search in input order, as its node ids."""

    def f(nodes, edges):
        next_, colour, out = successors(nodes, edges), {}, []
        for root in next_:
            if root in colour:
                continue
            path, work = [root], [iter(next_[root])]
            colour[root] = 1
            while work:
                t = next(work[-1], None)
                if t is None:
                    work.pop()
                    colour[path.pop()] = 2
                elif colour.get(t) == 1:
                    out.append((len(out), path[path.index(t) :]))
                elif t not in colour:
                    colour[t] = 1
                    path.append(t)
                    work.append(iter(next_[t]))
        return out

    return per_graph(g, f, "nth int, ids array<string>")


def feedback_arcs(next_: dict[str, list[str]]) -> set[tuple[str, str]]:
    """Greedy feedback arcs (sinks, sources, then the largest out minus in): reversing them leaves no cycle."""
    out_ = {v: {t for t in ts if t != v} for v, ts in next_.items()}
    in_: dict[str, set[str]] = {v: set() for v in next_}
    for v, ts in out_.items():
        for t in ts:
            in_[t].add(v)
    left, front, back = dict.fromkeys(next_), [], []

    def drop(v):
        del left[v]
        for t in out_[v]:
            in_[t].discard(v)
        for t in in_[v]:
            out_[t].discard(v)

    while left:
        if sinks := [v for v in left if not out_[v]]:
            back += sinks
            for v in sinks:
                drop(v)
        elif sources := [v for v in left if not in_[v]]:
            front += sources
            for v in sources:
                drop(v)
        else:
            v = max(left, key=lambda x: len(out_[x]) - len(in_[x]))
            front.append(v)
            drop(v)
    place = {v: i for i, v in enumerate(front + back[::-1])}
    return {(v, t) for v, ts in next_.items() for t in ts if v != t and place[v] > place[t]}


def feedback_edges(g: GraphFrames) -> DataFrame:
    """Edges that layout reverses so that no cycle is left; self-loops are left out of both."""

    def f(nodes, edges):
        next_ = successors(nodes, edges, loops=False)
        part = {v: i for i, c in enumerate(tarjan(next_)) for v in c}
        inside = {v: [t for t in ts if part[t] == part[v]] for v, ts in next_.items()}
        back = feedback_arcs(inside)
        return [(e["id"], (e["source"], e["target"]) in back) for e in edges if e["source"] in next_ and e["target"] in next_ and e["source"] != e["target"]]

    return per_graph(g, f, "id string, is_feedback boolean")
