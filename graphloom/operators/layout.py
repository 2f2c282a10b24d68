"""Layered, radial, grid and force layout of many graphs: set-oriented phases as DataFrames, sequential ones one graph a task."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.paths import feedback_arcs, kahn, per_graph, successors, tarjan
from graphloom.runtime import join_split, numbered, prepare_python, stage
from graphloom.schema import GraphFrames

# Sizes and gaps of drawn nodes.
WIDTH, HEIGHT, GAP_X, GAP_Y, LANE = 120.0, 60.0, 40.0, 80.0, 12.0


# ---- one graph: plain functions


def acyclic(nodes: list[dict], edges: list[dict]) -> list[tuple[str, str, float, int]]:
    """Arcs (source, target, weight, min_len) without self-loops, feedback arcs reversed, parallel ones merged."""
    next_ = successors(nodes, edges, loops=False)
    part = {v: i for i, c in enumerate(tarjan(next_)) for v in c}
    back = feedback_arcs({v: [t for t in ts if part[t] == part[v]] for v, ts in next_.items()})
    merged: dict[tuple[str, str], list] = {}
    for e in edges:
        a, b = e["source"], e["target"]
        if a in next_ and b in next_ and a != b:
            key = (b, a) if (a, b) in back else (a, b)
            one = merged.setdefault(key, [0.0, 1])
            one[0] += e["weight"]
            one[1] = max(one[1], int(e["min_len"]))
    return [(a, b, w, n) for (a, b), (w, n) in merged.items()]


def longest_path_ranks(ids: list[str], arcs: list[tuple]) -> dict[str, int]:
    next_, length = {v: [] for v in ids}, {}
    for a, b, _, n in arcs:
        next_[a].append(b)
        length[a, b] = n
    rank = dict.fromkeys(ids, 0)
    for v in kahn(next_)[0]:
        for t in next_[v]:
            rank[t] = max(rank[t], rank[v] + length[v, t])
    return rank


def tight_ranks(ids: list[str], arcs: list[tuple], rounds: int = 60) -> dict[str, int]:
    """Shorter total weighted span: starting from longest paths, each node moves to the best place between its neighbours."""
    rank = longest_path_ranks(ids, arcs)
    into, out = defaultdict(list), defaultdict(list)
    for a, b, w, n in arcs:
        into[b].append((a, w, n))
        out[a].append((b, w, n))
    for _ in range(rounds):
        moved = False
        for v in ids:
            low = max((rank[a] + n for a, _, n in into[v]), default=None)
            high = min((rank[b] - n for b, _, n in out[v]), default=None)
            pull = sum(w for _, w, _ in out[v]) - sum(w for _, w, _ in into[v])
            best = high if pull > 0 and high is not None else low if pull < 0 and low is not None else rank[v]
            if best != rank[v] and (low is None or best >= low) and (high is None or best <= high):
                rank[v], moved = best, True
        if not moved:
            break
    least = min(rank.values(), default=0)
    return {v: r - least for v, r in rank.items()}


def optimal_ranks(ids: list[str], arcs: list[tuple]) -> dict[str, int]:
    """Ranks of the least weighted sum of spans, by the network simplex method, component by component.

    A spanning tree of arcs without slack is kept. Cutting a tree arc parts the nodes in two sides; if the arcs that lead
    back weigh more than those along it, the far side moves away until the tightest arc back has no slack and takes the
    arc's place. Of several such arcs the first is taken, so that steps without gain come to an end.
    """
    rank = longest_path_ranks(ids, arcs)
    place = {v: i for i, v in enumerate(ids)}
    touching: dict[str, list[int]] = defaultdict(list)
    for k, (a, b, _, _) in enumerate(arcs):
        touching[a].append(k)
        touching[b].append(k)
    slack = lambda k: rank[arcs[k][1]] - rank[arcs[k][0]] - arcs[k][3]

    def side(start: str, links: set[int], without: int | None = None) -> set[str]:
        seen, work = {start}, [start]
        while work:
            v = work.pop()
            for k in touching[v]:
                if k in links and k != without:
                    other = arcs[k][1] if arcs[k][0] == v else arcs[k][0]
                    if other not in seen:
                        seen.add(other)
                        work.append(other)
        return seen

    left = dict.fromkeys(ids)
    while left:
        root = next(iter(left))
        part = side(root, set(range(len(arcs))))
        for v in part:
            del left[v]
        own = [k for k, (a, _, _, _) in enumerate(arcs) if a in part]
        tree: set[int] = set()
        grown = {root}
        while len(grown) < len(part):
            rim = [k for k in own if (arcs[k][0] in grown) != (arcs[k][1] in grown)]
            k = min(rim, key=lambda k: (slack(k), k))
            by = slack(k) if arcs[k][1] not in grown else -slack(k)
            for v in grown:
                rank[v] += by
            tree.add(k)
            grown |= {arcs[k][0], arcs[k][1]}
        for _ in range(50 * len(part) + 1000):
            for k in sorted(tree):
                far = side(arcs[k][1], tree, k)
                across = sum(w * (1 if b in far else -1) for a, b, w, _ in (arcs[j] for j in own) if (a in far) != (b in far))
                back = [j for j in own if arcs[j][0] in far and arcs[j][1] not in far]
                if across < 0 and back:
                    enter = min(back, key=lambda j: (slack(j), j))
                    by = slack(enter)
                    for v in far:
                        rank[v] += by
                    tree = tree - {k} | {enter}
                    break
            else:
                break
        else:
            raise RuntimeError(f"no optimal ranks after {50 * len(part) + 1000} exchanges of a graph of {len(part)} nodes")
        least = min(rank[v] for v in part)
        for v in sorted(part, key=place.get):
            rank[v] -= least
    return rank


def balanced_ranks(ids: list[str], arcs: list[tuple], most: int | None = None) -> dict[str, int]:
    """Optimal ranks evened out: a node with equal weights in and out moves to the emptiest rank that its arcs allow.

    With ``most`` nodes a rank at most, the last of a fuller rank move down, and what follows them moves as far as it must.
    """
    rank = optimal_ranks(ids, arcs)
    into, out = defaultdict(list), defaultdict(list)
    for a, b, w, n in arcs:
        into[b].append((a, w, n))
        out[a].append((b, w, n))
    held: dict[int, int] = defaultdict(int)
    for r in rank.values():
        held[r] += 1
    for v in ids:
        if into[v] and out[v] and sum(w for _, w, _ in into[v]) == sum(w for _, w, _ in out[v]):
            low, high = max(rank[a] + n for a, _, n in into[v]), min(rank[b] - n for b, _, n in out[v])
            best = min(range(low, high + 1), key=lambda r: (held[r] - (r == rank[v]), abs(r - rank[v]), r))
            held[rank[v]] -= 1
            held[best] += 1
            rank[v] = best
    r = 0
    while most and r <= max(rank.values(), default=-1):
        here = [v for v in ids if rank[v] == r]
        for v in here[most:]:
            rank[v] += 1
            work = deque([v])
            while work:
                a = work.popleft()
                for b, _, n in out[a]:
                    if rank[b] < rank[a] + n:
                        rank[b] = rank[a] + n
                        work.append(b)
        r += 1
    return rank


def layered(ids: list[str], arcs: list[tuple], rank: dict[str, int]) -> tuple[list[list[str]], list[tuple[str, str]]]:
    """Layers with dummies on long arcs, and the unit segments between adjoining layers."""
    layers: list[list[str]] = [[] for _ in range(max(rank.values(), default=-1) + 1)]
    for v in ids:
        layers[rank[v]].append(v)
    segments = []
    for a, b, _, _ in arcs:
        last = a
        for r in range(rank[a] + 1, rank[b]):
            layers[r].append(d := f"{a}->{b}#{r}")
            segments.append((last, d))
            last = d
        segments.append((last, b))
    return layers, segments


def count_crossings(upper: list[str], lower: list[str], segments: list[tuple[str, str]]) -> int:
    """Inversions by a binary indexed tree; segments that share an end never cross."""
    up, low = {v: i for i, v in enumerate(upper)}, {v: i for i, v in enumerate(lower)}
    pairs = sorted((up[a], low[b]) for a, b in segments if a in up and b in low)
    tree, total, seen, i = [0] * (len(lower) + 1), 0, 0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            k, below = pairs[j][1] + 1, 0
            while k > 0:
                below += tree[k]
                k -= k & -k
            total += seen - below
            j += 1
        for _, k in pairs[i:j]:
            k += 1
            while k <= len(lower):
                tree[k] += 1
                k += k & -k
        seen, i = seen + j - i, j
    return total


def inversions(places: list[int]) -> int:
    """Pairs out of order."""
    seen: list[int] = []
    total = 0
    for v in places:
        total += len(seen) - bisect_right(seen, v)
        insort(seen, v)
    return total


def _crossed(left: list[int], right: list[int]) -> int:
    """Crossings of the segments of two neighbours, from the sorted places of their ends."""
    return sum(bisect_left(right, x) for x in left)


def order_layers(layers: list[list[str]], segments: list[tuple[str, str]], sweeps: int = 8) -> tuple[list[list[str]], int]:
    """Median sweeps down and up with transpositions; the order with the fewest crossings."""
    above, below, layer_of = defaultdict(list), defaultdict(list), {v: r for r, x in enumerate(layers) for v in x}
    between = defaultdict(list)
    for a, b in segments:
        above[b].append(a)
        below[a].append(b)
        between[layer_of[a]].append((a, b))
    total = lambda ls: sum(count_crossings(ls[r], ls[r + 1], between[r]) for r in range(len(ls) - 1))
    work = [list(x) for x in layers]
    best, fewest = [list(x) for x in work], total(work)
    for sweep in range(sweeps):
        if not fewest:
            break
        down = sweep % 2 == 0
        for r in range(1, len(work)) if down else range(len(work) - 2, -1, -1):
            place = {v: i for i, v in enumerate(work[r - 1 if down else r + 1])}
            near = above if down else below

            def median(v, i, near=near, place=place):
                p = sorted(place[x] for x in near[v])
                return i if not p else p[len(p) // 2] if len(p) % 2 else (p[len(p) // 2 - 1] + p[len(p) // 2]) / 2

            keys = {v: median(v, i) for i, v in enumerate(work[r])}
            work[r].sort(key=lambda v: keys[v])
        for r, layer in enumerate(work):
            sides = [(near, {v: i for i, v in enumerate(work[k])}) for k, near in ((r - 1, above), (r + 1, below)) if 0 <= k < len(work)]
            ends = {v: [sorted(place[x] for x in near[v]) for near, place in sides] for v in layer}
            for i in range(len(layer) - 1):
                u, v = ends[layer[i]], ends[layer[i + 1]]
                # Only segments of the two swapped nodes change whether they cross.
                if sum(map(_crossed, v, u)) < sum(map(_crossed, u, v)):
                    layer[i], layer[i + 1] = layer[i + 1], layer[i]
        if (now := total(work)) < fewest:
            best, fewest = [list(x) for x in work], now
    return best, fewest


def rank_table(g: GraphFrames, method: str = "longest_path", most: int | None = None) -> DataFrame:
    """Ranks by ``longest_path``, ``tight`` (local moves), ``optimal`` (network simplex) or ``balanced`` (``most`` nodes a rank)."""
    rank = {"longest_path": longest_path_ranks, "tight": tight_ranks, "optimal": optimal_ranks, "balanced": lambda i, a: balanced_ranks(i, a, most)}[method]

    def f(nodes, edges):
        got = rank([n["id"] for n in nodes], acyclic(nodes, edges))
        return list(got.items())

    return per_graph(g, f, "id string, rank int")


def rank_costs(g: GraphFrames, ranks: DataFrame) -> DataFrame:
    """Per graph: edges, edges that don't run down by their least length, and the weighted sum of spans, of an acyclic graph."""
    at = lambda end: ranks.select("graph_id", F.col("id").alias(end), F.col("rank").alias(f"{end}_rank"))
    e = g.edges.join(at("source"), ["graph_id", "source"]).join(at("target"), ["graph_id", "target"])
    span = F.col("target_rank") - F.col("source_rank")
    return e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(span < F.coalesce("min_len", F.lit(1))).alias("short"), F.sum(span * F.coalesce("weight", F.lit(1.0))).alias("cost"))


def crossing_search(g: GraphFrames) -> DataFrame:
    """Crossings before and after the ordering search."""

    def f(nodes, edges):
        ids, arcs = [n["id"] for n in nodes], acyclic(nodes, edges)
        layers, segments = layered(ids, arcs, tight_ranks(ids, arcs))
        inside = defaultdict(list)
        of = {v: r for r, x in enumerate(layers) for v in x}
        for a, b in segments:
            inside[of[a]].append((a, b))
        before = sum(count_crossings(layers[r], layers[r + 1], inside[r]) for r in range(len(layers) - 1))
        return [(before, order_layers(layers, segments)[1], len(layers), len(segments))]

    return per_graph(g, f, "crossings_before int, crossings_after int, layers int, segments int")


def force_layout(g: GraphFrames, steps: int = 120, seed: int = 1, theta: float = 0.8) -> DataFrame:
    """Springs along edges, repulsion between all by a quadtree's far cells, cooling; positions are determined by the seed."""

    def repulsion(p: np.ndarray, at: np.ndarray, strength: float) -> np.ndarray:
        force = np.zeros_like(p)
        lo, hi = p.min(0), p.max(0)
        work = [(np.arange(len(p)), lo, float(max(hi - lo)) + 1e-6, np.arange(len(p)))]
        while work:
            inside, corner, size, asking = work.pop()
            if not len(inside) or not len(asking):
                continue
            centre = p[inside].mean(0)
            d = p[asking] - centre
            dist = np.sqrt((d**2).sum(1)) + 1e-9
            far = (size / dist < theta) | (len(inside) == 1)
            own = np.isin(asking, inside) & (len(inside) == 1)
            use = far & ~own
            force[asking[use]] += d[use] * (strength * len(inside) / np.maximum(dist[use], 1.0) ** 2)[:, None]
            rest = asking[~far]
            if len(rest) and size > 1e-3:
                half = size / 2
                right, low = p[inside, 0] >= corner[0] + half, p[inside, 1] >= corner[1] + half
                for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
                    work.append((inside[(right == bool(i)) & (low == bool(j))], corner + np.array([i, j]) * half, half, rest))
        return force

    def f(nodes, edges):
        if not nodes:
            return []
        r, index = np.random.default_rng(seed), {n["id"]: i for i, n in enumerate(nodes)}
        p = r.standard_normal((len(nodes), 2)) * 100 + np.arange(len(nodes))[:, None] * 0.01
        pairs = np.array([(index[e["source"]], index[e["target"]]) for e in edges if e["source"] in index and e["target"] in index and e["source"] != e["target"]] or np.zeros((0, 2)), int)
        for k in range(steps):
            move = repulsion(p, p, 900.0)
            d = p[pairs[:, 1]] - p[pairs[:, 0]]
            dist = np.sqrt((d**2).sum(1, keepdims=True)) + 1e-9
            pull = d / dist * (dist - 120) * 0.1
            np.add.at(move, pairs[:, 0], pull)
            np.add.at(move, pairs[:, 1], -pull)
            move -= p * 0.01
            size = np.sqrt((move**2).sum(1, keepdims=True)) + 1e-9
            p = p + move / size * np.minimum(size, 30 * (1 - k / steps))
        return [(n["id"], float(p[i, 0]), float(p[i, 1])) for i, n in enumerate(nodes)]

    return per_graph(g, f, "id string, x double, y double")


# ---- set-oriented phases


def grid_layout(g: GraphFrames) -> DataFrame:
    """Rows as long as the square root of the graph's size, in input order; places are counted by ranges, whatever the size."""
    n = numbered(g.nodes.select("graph_id", "id", "ord"), [F.col("graph_id"), F.col("ord"), F.col("id")], "place")
    sizes = n.groupBy("graph_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    n = join_split(n, stage(sizes, "sizes"), "graph_id", "size", n.count())
    i, per_row = F.col("place") - F.col("first"), F.ceil(F.sqrt("size"))
    return n.select("graph_id", "id", ((i % per_row) * (WIDTH + GAP_X)).alias("x"), (F.floor(i / per_row) * (HEIGHT + GAP_Y)).alias("y"))


def rank_bands(placed: DataFrame, gap: float = GAP_Y) -> DataFrame:
    """Top of each rank from (graph_id, rank, height): a running sum of the tallest nodes and gaps."""
    b = placed.groupBy("graph_id", "rank").agg(F.max("height").alias("height"))
    before = Window.partitionBy("graph_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("top", F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0.0)))


def dummies(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """A dummy (graph_id, edge_id, rank) on every rank that an edge passes."""
    a = ranks.select("graph_id", F.col("id").alias("source"), F.col("rank").alias("ra"))
    b = ranks.select("graph_id", F.col("id").alias("target"), F.col("rank").alias("rb"))
    e = edges.join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"]).withColumns({"lo": F.least("ra", "rb"), "hi": F.greatest("ra", "rb")}).filter("hi - lo > 1")
    return e.select("graph_id", F.col("id").alias("edge_id"), F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("rank"))


def crossings(segments: DataFrame) -> DataFrame:
    """Crossings per (graph_id, rank) of segments (u, v places): inverted pairs, strict on both sides; ranks without any are left out.

    Segments of a rank are sorted and counted in a row of their own, not paired.
    """
    prepare_python(segments.sparkSession)
    packed = segments.groupBy("graph_id", "rank").agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("s"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [inversions([x["v"] for x in row]) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["graph_id", "rank", "crossings"])

    kind = segments.schema["rank"].dataType.simpleString()
    return packed.mapInArrow(count, f"graph_id string, rank {kind}, crossings long").filter("crossings > 0")


def lane_demand(intervals: DataFrame) -> DataFrame:
    """Lanes per channel (graph_id, channel) of intervals (lo, hi): the largest overlap; touching ones overlap."""
    p = intervals.select("graph_id", "channel", F.col("lo").alias("t"), F.lit(0).alias("k"), F.lit(1).alias("d")).unionByName(intervals.select("graph_id", "channel", F.col("hi").alias("t"), F.lit(1).alias("k"), F.lit(-1).alias("d")))
    p = p.groupBy("graph_id", "channel", "t", "k").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy("graph_id", "channel").orderBy("t", "k"))
    return p.withColumn("open", run).groupBy("graph_id", "channel").agg(F.max("open").alias("lanes"))


def segments_of(paths: DataFrame, *more: str) -> DataFrame:
    """Segments of routes (graph_id, id, xs, ys), without repeated points; ``more`` columns of the routes are kept. Nothing is shuffled."""
    after = lambda c: F.slice(c, 2, F.size(c)).alias(f"{c}_after")
    s = paths.select("graph_id", "id", *more, F.posexplode(F.arrays_zip("xs", "ys", after("xs"), after("ys"))).alias("pos", "p"))
    s = s.select("graph_id", "id", *more, "pos", F.col("p")["xs"].alias("ax"), F.col("p")["ys"].alias("ay"), F.col("p")["xs_after"].alias("bx"), F.col("p")["ys_after"].alias("by"))
    return s.filter("bx is not null and (ax <> bx or ay <> by)")


def layout_metrics(placed: DataFrame, paths: DataFrame) -> DataFrame:
    """Bends (turns of simplified routes), Manhattan length, area and aspect (1 where there is no height)."""
    s = segments_of(paths)
    w = Window.partitionBy("graph_id", "id").orderBy("pos")
    s = s.withColumn("turn", (F.signum(F.col("bx") - F.col("ax")) != F.lag(F.signum(F.col("bx") - F.col("ax"))).over(w)) | (F.signum(F.col("by") - F.col("ay")) != F.lag(F.signum(F.col("by") - F.col("ay"))).over(w)))
    r = s.groupBy("graph_id").agg(F.count_if("turn").alias("bends"), F.sum(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay"))).alias("length"), F.min(F.least("ax", "bx")).alias("rx0"), F.max(F.greatest("ax", "bx")).alias("rx1"), F.min(F.least("ay", "by")).alias("ry0"), F.max(F.greatest("ay", "by")).alias("ry1"))
    n = placed.groupBy("graph_id").agg(F.min("x").alias("x0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.min("y").alias("y0"), F.max(F.col("y") + F.col("height")).alias("y1"))
    j = n.join(r, "graph_id", "left")
    width, height = F.greatest("x1", "rx1") - F.least("x0", "rx0"), F.greatest("y1", "ry1") - F.least("y0", "ry0")
    return j.select("graph_id", F.coalesce("bends", F.lit(0)).alias("bends"), F.coalesce("length", F.lit(0.0)).alias("length"), (width * height).alias("area"), F.when(height > 0, width / height).otherwise(1.0).alias("aspect"))


def constraint_scan(placed: DataFrame, paths: DataFrame, cell: float = 200) -> DataFrame:
    """Violations per graph: overlapping boxes, and routes through boxes of nodes that aren't their ends."""
    from graphloom.operators.collab import overlaps

    boxes = overlaps(placed, cell).groupBy("graph_id").agg(F.count(F.lit(1)).alias("box_overlaps"))
    b = placed.select("graph_id", F.col("id").alias("node"), "x", "y", "width", "height", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("width")) / cell))).alias("cx")).select("*", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("height")) / cell))).alias("cy"))
    span = lambda a, c: F.explode(F.sequence(F.floor(F.least(a, c) / cell), F.floor(F.greatest(a, c) / cell)))
    s = segments_of(paths).select("*", span("ax", "bx").alias("cx")).select("*", span("ay", "by").alias("cy"))
    hit = s.join(b, ["graph_id", "cx", "cy"]).filter("greatest(ax, bx) > x and least(ax, bx) < x + width and greatest(ay, by) > y and least(ay, by) < y + height")
    through = hit.select("graph_id", "id", "node").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("routes_through_boxes"))
    out = placed.select("graph_id").distinct().join(boxes, "graph_id", "left").join(through, "graph_id", "left")
    return out.fillna(0)


def gate_scan(g: GraphFrames, placed: DataFrame, paths: DataFrame, cell: float = 200) -> DataFrame:
    """Per graph the violations of eight hard constraints of a layout and its orthogonal routes.

    Overlapping boxes; routes through boxes of other nodes; boxes or points that aren't finite; nodes without a box; edges
    between nodes without a route; slanted segments; routes that don't begin and end on the rims of their ends' boxes; routes
    that run along the same line as another's between other ends. All tables are of the size of the graphs: their joins
    shuffle, as files of drawings are many times smaller than what a broadcast of them holds on the driver.
    """
    g, placed, paths = GraphFrames(g.nodes.hint("merge"), g.edges.hint("merge")), placed.hint("merge"), paths.hint("merge")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < 1e300), F.lit(False))
    count = lambda df, name: df.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))
    bad_box = ~(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("width")) & finite(F.col("height")))
    bad_path = F.coalesce(F.exists("xs", lambda v: ~finite(v)) | F.exists("ys", lambda v: ~finite(v)), F.lit(False))
    infinite = count(placed.filter(bad_box).select("graph_id").unionAll(paths.filter(bad_path).select("graph_id")), "not_finite")
    good, boxes = paths.filter(~bad_path), placed.filter(~bad_box)
    unplaced = count(g.nodes.select("graph_id", "id").join(placed, ["graph_id", "id"], "left_anti"), "unplaced_nodes")
    unrouted = count(g.valid_edges().select("graph_id", "id").join(paths, ["graph_id", "id"], "left_anti"), "unrouted_edges")
    s = segments_of(good)
    slanted = count(s.filter("ax <> bx and ay <> by").select("graph_id", "id").distinct(), "slanted_routes")
    ends = good.join(g.edges.select("graph_id", "id", "source", "target"), ["graph_id", "id"])
    loose = None
    for end, nth in (("source", 1), ("target", -1)):
        box = boxes.select("graph_id", F.col("id").alias(end), F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("width")).alias("r"), (F.col("y") + F.col("height")).alias("b"))
        j = ends.select("graph_id", "id", end, F.element_at("xs", nth).alias("px"), F.element_at("ys", nth).alias("py")).join(box, ["graph_id", end])
        near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-6
        inside = F.col("px").between(F.col("l") - 1e-6, F.col("r") + 1e-6) & F.col("py").between(F.col("t") - 1e-6, F.col("b") + 1e-6)
        off = j.filter(~(inside & (near("px", "l") | near("px", "r") | near("py", "t") | near("py", "b")))).select("graph_id", "id")
        loose = off if loose is None else loose.unionByName(off)
    loose = count(loose.distinct(), "loose_routes")
    level = F.col("ay") == F.col("by")
    of = lambda f, a, b: F.when(level, f(f"{a}x", f"{b}x")).otherwise(f(f"{a}y", f"{b}y"))
    lines = segments_of(ends, "source", "target").filter("ax = bx or ay = by")
    lines = lines.select("graph_id", "id", "source", "target", level.alias("is_level"), F.when(level, F.col("ay")).otherwise(F.col("ax")).alias("at"), of(F.least, "a", "b").alias("lo"), of(F.greatest, "a", "b").alias("hi"))
    # In order of their beginnings, a segment shares its line with one before it if that reaches beyond its beginning.
    before = Window.partitionBy("graph_id", "is_level", "at").orderBy("lo", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("hi", "source", "target", F.col("id").alias("of"))).over(before)
    met = lines.withColumn("last", last).filter("last.hi > lo + 1e-6 and last.of <> id and last.source <> source and last.target <> target")
    shared = count(met.select("graph_id", "id").distinct(), "shared_lines")
    out = constraint_scan(boxes, good, cell)
    out = g.nodes.select("graph_id").distinct().join(out, "graph_id", "left")
    for more in (infinite, unplaced, unrouted, slanted, loose, shared):
        out = out.join(more, "graph_id", "left")
    return out.fillna(0)


def geometric_crossings(paths: DataFrame, cell: float = 200) -> DataFrame:
    """Proper crossings of segments of different routes, by the grid cells they pass."""
    span = lambda a, c: F.explode(F.sequence(F.floor(F.least(a, c) / cell), F.floor(F.greatest(a, c) / cell)))
    s = segments_of(paths).select("*", span("ax", "bx").alias("cx")).select("*", span("ay", "by").alias("cy"))
    side = lambda t: s.select("graph_id", "cx", "cy", *[F.col(c).alias(f"{t}_{c}") for c in ("id", "pos", "ax", "ay", "bx", "by")])
    from graphloom.functions.scalars import segments_cross

    c = F.col
    j = side("p").join(side("q"), ["graph_id", "cx", "cy"]).filter("p_id < q_id")
    j = j.filter(segments_cross(c("p_ax"), c("p_ay"), c("p_bx"), c("p_by"), c("q_ax"), c("q_ay"), c("q_bx"), c("q_by")))
    return j.select("graph_id", "p_id", "p_pos", "q_id", "q_pos").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("crossings"))


def pack_components(extents: DataFrame, width: float = 2400, gap: float = 60) -> DataFrame:
    """Shelf offsets of components (graph_id, component, width, height), tallest first: as many a shelf as fit on average."""
    w = Window.partitionBy("graph_id")
    e = extents.withColumn("nth", F.row_number().over(w.orderBy(F.desc("height"), "component")) - 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(width) / (F.max("width").over(w) + gap)))
    e = e.withColumn("shelf", F.floor(F.col("nth") / per))
    x = F.coalesce(F.sum(F.col("width") + gap).over(Window.partitionBy("graph_id", "shelf").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tall = e.groupBy("graph_id", "shelf").agg(F.max("height").alias("tall"))
    y = F.coalesce(F.sum(F.col("tall") + gap).over(Window.partitionBy("graph_id").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return e.withColumn("dx", x).join(tall.withColumn("dy", y).drop("tall"), ["graph_id", "shelf"]).select("graph_id", "component", "dx", "dy")


def oriented(placed: DataFrame, direction: str) -> DataFrame:
    """A top-to-bottom layout turned: BT mirrors y, LR swaps the axes, RL does both."""
    w = Window.partitionBy("graph_id")
    if direction in ("LR", "RL"):
        placed = placed.withColumns({"x": F.col("y"), "y": F.col("x"), "width": F.col("height"), "height": F.col("width")})
    if direction == "BT":
        placed = placed.withColumn("y", F.max(F.col("y") + F.col("height")).over(w) - F.col("y") - F.col("height"))
    if direction == "RL":
        placed = placed.withColumn("x", F.max(F.col("x") + F.col("width")).over(w) - F.col("x") - F.col("width"))
    return placed


def measured(g: GraphFrames, per_char: float = 8.0, padding: float = 24.0) -> DataFrame:
    """Box of each node estimated from its name."""
    return g.nodes.select("graph_id", "id", F.greatest(F.lit(WIDTH), F.length(F.coalesce("name", "id")) * per_char + padding).alias("width"), F.lit(HEIGHT).alias("height"))


def convex_hulls(points: DataFrame) -> DataFrame:
    """Hull of each group (graph_id, cluster) of points (x, y)."""
    import pandas as pd

    from graphloom.functions.scalars import convex_hull
    from graphloom.runtime import prepare_python

    prepare_python(points.sparkSession)

    def f(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(rows["x"], rows["y"])))
        return pd.DataFrame([(*key, [p[0] for p in hull], [p[1] for p in hull])], columns=["graph_id", "cluster", "xs", "ys"])

    return points.groupBy("graph_id", "cluster").applyInPandas(f, "graph_id string, cluster string, xs array<double>, ys array<double>")


def bundles(g: GraphFrames) -> DataFrame:
    """Edges between the same two nodes, whatever their direction (a before b), self-loops and lost ends left out: their number,
    how many run each way, their weights together and the first of them."""
    e = g.valid_edges().filter("source <> target").withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    ahead = F.col("source") == F.col("a")
    return e.groupBy("graph_id", "a", "b").agg(F.count(F.lit(1)).alias("edges"), F.count_if(ahead).alias("forward"), F.count_if(~ahead).alias("backward"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.min_by("id", "ord").alias("first"))
