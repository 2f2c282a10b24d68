"""Layered drawings: coordinates by four aligned assignments, ports, channels with lanes, orthogonal routes and labels.

One graph is held at a time, many to an Arrow batch. Ranks, orders and crossings come from ``layout``; here every edge has a
chain of its own, so parallel and opposite edges run apart.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.layout import GAP_X, GAP_Y, HEIGHT, LANE, WIDTH, acyclic, order_layers, segments_of, tight_ranks
from graphloom.operators.paths import per_graph
from graphloom.runtime import stage
from graphloom.schema import GraphFrames

#: Nearest that two vertical lines of a channel may come, and that intervals of one lane may.
CLEAR = 1.0


def conflicts(layers: list[list[str]], segments: list[tuple[str, str]], dummies: set[str]) -> set[tuple[str, str]]:
    """Segments that are not aligned: those that cross an inner one (between two dummies), and of two inner ones the later."""
    place, layer_of = {}, {}
    for r, layer in enumerate(layers):
        for i, v in enumerate(layer):
            place[v], layer_of[v] = i, r
    by_layer = defaultdict(list)
    for a, b in segments:
        by_layer[layer_of[a]].append((place[a], place[b], a in dummies and b in dummies, (a, b)))
    out = set()
    for some in by_layer.values():
        some.sort(key=lambda s: s[:2])
        for i, (u, v, inner, _) in enumerate(some):
            if inner and some[i][3] not in out:
                for j, (x, y, also, name) in enumerate(some):
                    if (x - u) * (y - v) < 0 and not (also and j < i):
                        out.add(name)
    return out


def _aligned(layers: list[list[str]], near: dict[str, list[str]], barred: set[tuple[str, str]]) -> dict[str, str]:
    """The root of each node's block: nodes join their median neighbour of the layer before, without crossing each other."""
    root = {v: v for layer in layers for v in layer}
    taken: set[str] = set()
    for before, layer in zip(layers, layers[1:]):
        place, last = {v: i for i, v in enumerate(before)}, -1
        for v in layer:
            ends = sorted((u for u in near[v] if u in place), key=place.__getitem__)
            for m in sorted({(len(ends) - 1) // 2, len(ends) // 2}) if ends else ():
                u = ends[m]
                if root[v] == v and u not in taken and (u, v) not in barred and (v, u) not in barred and place[u] > last:
                    root[v], last = root[u], place[u]
                    taken.add(u)
    return root


def _compacted(layers: list[list[str]], root: dict[str, str], apart) -> dict[str, float]:
    """Blocks as far left as the distances in all their layers let them, then moved up to their right neighbours."""
    gaps: dict[str, dict[str, float]] = defaultdict(dict)
    waiting = dict.fromkeys(root.values(), 0)
    for layer in layers:
        for a, b in zip(layer, layer[1:]):
            x, y = root[a], root[b]
            if y not in gaps[x]:
                waiting[y] += 1
            gaps[x][y] = max(gaps[x].get(y, 0.0), apart(a, b))
    queue, order, at = deque(v for v, n in waiting.items() if not n), [], dict.fromkeys(waiting, 0.0)
    while queue:
        order.append(v := queue.popleft())
        for w, d in gaps[v].items():
            at[w] = max(at[w], at[v] + d)
            waiting[w] -= 1
            if not waiting[w]:
                queue.append(w)
    for v in reversed(order):
        if gaps[v]:
            at[v] = max(at[v], min(at[w] - d for w, d in gaps[v].items()))
    return {v: at[r] for v, r in root.items()}


def coordinates(layers: list[list[str]], segments: list[tuple[str, str]], width: dict[str, float], dummies: set[str]) -> dict[str, float]:
    """Centres along the layers: four assignments, by alignment up or down and packing left or right, are laid over the
    narrowest, and each node takes the mean of its two middle places. Distances hold in each, and so in the mean.
    """
    up, down = defaultdict(list), defaultdict(list)
    for a, b in segments:
        up[b].append(a)
        down[a].append(b)
    barred = conflicts(layers, segments, dummies)
    apart = lambda a, b: (width.get(a, LANE) + width.get(b, LANE)) / 2 + GAP_X
    four = []
    for near, ordered in ((up, layers), (down, layers[::-1])):
        for sign in (1, -1):
            work = [layer[::sign] for layer in ordered]
            at = _compacted(work, _aligned(work, near, barred), apart)
            four.append((sign, {v: sign * x for v, x in at.items()}))
    if not four[0][1]:
        return {}
    spans = [(max(x.values()) - min(x.values()), k) for k, (_, x) in enumerate(four)]
    best = four[min(spans)[1]][1]
    low, high = min(best.values()), max(best.values())
    for sign, x in four:
        shift = low - min(x.values()) if sign == 1 else high - max(x.values())
        for v in x:
            x[v] += shift
    out = {}
    for v in four[0][1]:
        some = sorted(x[v] for _, x in four)
        out[v] = (some[1] + some[2]) / 2
    least = min(out[v] - width.get(v, LANE) / 2 for v in out)
    return {v: x - least for v, x in out.items()}


def lanes_of(nets: list[tuple[float, float]]) -> list[list[tuple[float, float, int]]]:
    """Lanes for the nets of a channel (x above, x below): for each its runs (from, to, lane), lane 0 the highest.

    Where a net leaves at the place below which another one enters, its run must be the lower one. Lanes are filled from
    the top by left ends with the nets whose turn it is; a circle of such demands is broken by a net that changes lanes at a
    free place. A net that doesn't turn has no runs.
    """
    pieces = [(t, b, k, 0) for k, (t, b) in enumerate(nets) if t != b]
    used = sorted({x for net in nets for x in net})
    out: list[list[tuple[float, float, int]]] = [[] for _ in nets]
    placed: dict[tuple[int, int], int] = {}
    lane = 0

    def demands(p: tuple) -> list[tuple]:
        """Pieces that must run above this one: they enter where it leaves, or come before it in its own net."""
        own = [q for q in pieces if q[2] == p[2] and q[3] < p[3]]
        return own + [q for q in by_top.get(round(p[1] / CLEAR), ()) if q[2] != p[2] and abs(q[0] - p[1]) < CLEAR]

    def index() -> dict[int, list[tuple]]:
        got: dict[int, list[tuple]] = defaultdict(list)
        for q in pieces:
            for d in (-1, 0, 1):
                got[round(q[0] / CLEAR) + d].append(q)
        return got

    by_top = index()
    while pieces:
        free = [p for p in pieces if not demands(p)]
        if not free:
            p = max(pieces, key=lambda q: (abs(q[0] - q[1]), -q[2]))
            middle, k = (p[0] + p[1]) / 2, 0
            while any(abs(middle - x) < 2 * CLEAR for x in used):
                k += 1
                middle = (p[0] + p[1]) / 2 + (k // 2 + 1) * 2.5 * CLEAR * (-1 if k % 2 else 1)
            used.append(middle)
            pieces.remove(p)
            later = [q for q in pieces if q[2] == p[2]]
            pieces = [q for q in pieces if q[2] != p[2]] + [(p[0], middle, p[2], p[3]), (middle, p[1], p[2], p[3] + 1)] + [(q[0], q[1], q[2], q[3] + 1) for q in later]
            by_top = index()
            continue
        last = None
        for p in sorted(free, key=lambda q: (min(q[:2]), max(q[:2]), q[2])):
            lo, hi = min(p[:2]), max(p[:2])
            if last is None or lo > last + CLEAR:
                placed[p[2], p[3]] = lane
                out[p[2]].append((p[0], p[1], lane))
                last = hi
                pieces.remove(p)
        by_top = index()
        lane += 1
    return out


def _sizes(nodes: list[dict]) -> dict[str, float]:
    return {n["id"]: max(WIDTH, 8.0 * n["chars"] + 24) for n in nodes}


def drawn(nodes: list[dict], edges: list[dict]) -> tuple:
    """Ranks, layers, centres and each edge's chain from its upper to its lower end."""
    ids, arcs = [n["id"] for n in nodes], acyclic(nodes, edges)
    rank = tight_ranks(ids, arcs)
    down = {(a, b) for a, b, _, _ in arcs}
    layers: list[list[str]] = [[] for _ in range(max(rank.values(), default=-1) + 1)]
    for v in ids:
        layers[rank[v]].append(v)
    chains, dummies, segments = {}, set(), []
    for k, e in enumerate(edges):
        a, b = e["source"], e["target"]
        if a in rank and b in rank and a != b:
            a, b = (a, b) if (a, b) in down else (b, a)
            inner = [f"{a}->{b}#{k}#{r}" for r in range(rank[a] + 1, rank[b])]
            for r, d in enumerate(inner, rank[a] + 1):
                layers[r].append(d)
            dummies.update(inner)
            chains[k] = chain = [a, *inner, b]
            segments += zip(chain, chain[1:])
    layers, _ = order_layers(layers, segments)
    width = _sizes(nodes)
    return rank, layers, coordinates(layers, segments, width, dummies), chains, width


_BOX = "id string, rank int, place int, x double, y double, width double, height double"
_ROUTE = "id string, xs array<double>, ys array<double>, is_reversed boolean, out_side string, out_port int, in_side string, in_port int"


def _boxes(nodes: list[dict], drawing: tuple) -> list[tuple]:
    rank, layers, x, _, width = drawing
    place = {v: i for layer in layers for i, v in enumerate(layer)}
    return [(n["id"], rank[n["id"]], place[n["id"]], x[n["id"]] - width[n["id"]] / 2, rank[n["id"]] * (HEIGHT + GAP_Y), width[n["id"]], HEIGHT) for n in nodes]


def layered_layout(g: GraphFrames) -> DataFrame:
    """Ranks, order, positions and sizes of nodes; top to bottom."""
    return per_graph(g, lambda nodes, edges: _boxes(nodes, drawn(nodes, edges)), _BOX)


def _routed(edges: list[dict], drawing: tuple) -> list[tuple]:
    rank, _, x, chains, width = drawing
    step = HEIGHT + GAP_Y
    sides: dict[tuple[str, int], list[tuple]] = defaultdict(list)
    for k, chain in chains.items():
        sides[chain[0], 1].append((x[chain[1]], k))
        sides[chain[-1], 0].append((x[chain[-2]], k))
    port = {}
    for (v, side), ends in sides.items():
        for i, (_, k) in enumerate(sorted(ends)):
            port[k, side] = (x[v] - width[v] / 2 + width[v] * (i + 1) / (len(ends) + 1), i)
    channels: dict[int, list[tuple[int, int, float, float]]] = defaultdict(list)
    for k, chain in chains.items():
        xs = [port[k, 1][0], *(x[d] for d in chain[1:-1]), port[k, 0][0]]
        for j in range(len(chain) - 1):
            channels[rank[chain[0]] + j].append((k, j, xs[j], xs[j + 1]))
    runs = {}
    for r, nets in channels.items():
        got = lanes_of([(a, b) for _, _, a, b in nets])
        most = max((lane for net in got for _, _, lane in net), default=0) + 1
        for (k, j, _, _), net in zip(nets, got):
            runs[k, j] = [(a, b, r * step + HEIGHT + GAP_Y * (lane + 1) / (most + 1)) for a, b, lane in sorted(net, key=lambda n: n[2])]
    loops: dict[str, list[int]] = defaultdict(list)
    for k, e in enumerate(edges):
        if e["source"] == e["target"] and e["source"] in rank:
            loops[e["source"]].append(k)
    out = []
    for k, e in enumerate(edges):
        if k in chains:
            chain = chains[k]
            points = [(port[k, 1][0], rank[chain[0]] * step + HEIGHT)]
            for j in range(len(chain) - 1):
                for a, b, y in runs[k, j]:
                    points += [(a, y), (b, y)]
            points.append((port[k, 0][0], rank[chain[-1]] * step))
            ahead = chain[0] == e["source"]
            ends = (("bottom", port[k, 1][1]), ("top", port[k, 0][1]))
            (out_side, out_port), (in_side, in_port) = ends if ahead else ends[::-1]
            points = points if ahead else points[::-1]
            out.append((e["id"], [float(p[0]) for p in points], [float(p[1]) for p in points], not ahead, out_side, out_port, in_side, in_port))
        elif e["source"] == e["target"] and e["source"] in rank:
            v, own = e["source"], loops[e["source"]]
            i, n = own.index(k), len(own)
            right, top = x[v] + width[v] / 2, rank[v] * step
            far, off = right + 4 + (GAP_X - 12) * (i + 1) / (n + 1), 5 + 20 * (n - i) / (n + 1)
            out.append((e["id"], [right, far, far, right], [top + off, top + off, top + HEIGHT - off, top + HEIGHT - off], False, "right", 2 * i, "right", 2 * i + 1))
    return out


def routes(g: GraphFrames) -> DataFrame:
    """Orthogonal routes of edges as points, with the ports that they take: out at the bottom, through lanes, in at the top.

    The edges of a side share it evenly, in order of where they go, so each has a port of its own. Between ranks, runs take
    the lanes of ``lanes_of``. Edges that the ranks reverse have their points from source to target all the same. Self-loops
    are nested at the right side.
    """
    return per_graph(g, lambda nodes, edges: _routed(edges, drawn(nodes, edges)), _ROUTE)


def layered_drawing(g: GraphFrames) -> tuple[DataFrame, DataFrame]:
    """The tables of ``layered_layout`` and ``routes``, for which each graph is drawn once; written to the scratch folder."""
    box, route = ([c.split()[0] for c in ddl.split(", ")] for ddl in (_BOX, _ROUTE))

    def f(nodes, edges):
        drawing = drawn(nodes, edges)
        boxes = [(*row, *[None] * (len(route) - 1), False) for row in _boxes(nodes, drawing)]
        return boxes + [(row[0], *[None] * (len(box) - 1), *row[1:], True) for row in _routed(edges, drawing)]

    both = stage(per_graph(g, f, f"{_BOX}, {_ROUTE.removeprefix('id string, ')}, is_route boolean"), "drawn")
    return both.filter("not is_route").select("graph_id", *box), both.filter("is_route").select("graph_id", *route)


def badges(g: GraphFrames, paths: DataFrame, per_char: float = 7.0, padding: float = 12.0, height: float = 18.0) -> DataFrame:
    """A box for each labelled edge's badge, in the middle of the longest run of its route, level runs first."""
    s = segments_of(paths).withColumn("size", F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay")))
    best = Window.partitionBy("graph_id", "id").orderBy(F.desc(F.col("ay") == F.col("by")), F.desc("size"), "pos")
    s = s.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    text = F.coalesce("label", "kind")
    named = g.edges.select("graph_id", "id", text.alias("text")).filter("text is not null and text <> ''").withColumn("width", per_char * F.length("text") + padding)
    middle = lambda a, b, size: (F.col(a) + F.col(b)) / 2 - size / 2
    return named.join(s, ["graph_id", "id"]).select("graph_id", "id", "text", middle("ax", "bx", F.col("width")).alias("x"), middle("ay", "by", F.lit(height)).alias("y"), "width", F.lit(height).alias("height"))
