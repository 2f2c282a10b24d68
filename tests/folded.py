"""The state of a log by one ordered fold in memory, which the distributed state must equal."""

import json

from graphloom.operators.replay import ALIASES, CLAIM, CREATE, EDGE_REMOVE, FAIL, PASS, REMOVE, RUN


def normalised_status(status: str | None) -> str:
    s = (status or "pending").lower()
    return ALIASES.get(s, s)


def fold(events: list[dict]) -> dict:
    """State after the events: tasks, nodes, edges, leases and the failed set."""
    tasks: dict[str, str] = {}
    nodes: dict[str, dict] = {}
    edges: dict[str, tuple[str, str]] = {}
    leases: dict[str, str] = {}
    failed: set[str] = set()

    def settle(t: str, status: str) -> None:
        tasks[t] = status
        if t in nodes:
            nodes[t]["status"] = status

    for e in events:
        payload, projection = json.loads(e.get("payload") or "{}"), json.loads(e.get("projection") or "{}")
        for i, t in enumerate(projection.get("tasks") or []):
            name, status = t.get("id"), normalised_status(t.get("status"))
            if not name:
                continue
            tasks[name] = status
            nodes[name] = {"status": status, "step": i + 1, "kind": (nodes.get(name) or {}).get("kind", "agent")}
            if t.get("lease"):
                leases[name] = str(t["lease"])
            elif status in ("success", "cached"):
                leases.pop(name, None)
            failed.add(name) if status == "error" else failed.discard(name) if status == "success" else None
        graph = projection.get("graph") or {}
        for n in graph.get("nodes") or []:
            if n.get("id"):
                nodes.setdefault(n["id"], {"status": normalised_status(n.get("status")), "step": None, "kind": n.get("kind", "agent")})
        for x in graph.get("edges") or []:
            edges[f"{x['source']}->{x['target']}"] = (x["source"], x["target"])
        verb, t = e["kind"], payload.get("task_id") or payload.get("id")
        if verb in EDGE_REMOVE:
            edges.pop(payload.get("edge_id") or payload.get("id"), None)
        elif t is None:
            continue
        elif verb in CREATE:
            tasks[t], nodes[t] = "pending", {"status": "pending", "step": None, "kind": "agent"}
        elif verb in CLAIM:
            settle(t, "running")
            leases[t] = str(e.get("actor") or payload.get("agent") or "")
        elif verb in RUN:
            if t in tasks:
                settle(t, "running")
        elif verb in FAIL:
            failed.add(t)
            if t in tasks:
                settle(t, "error")
        elif verb in PASS and (verb != "review-recorded" or payload.get("passed")):
            if t in tasks:
                settle(t, "success")
            leases.pop(t, None)
            failed.discard(t)
        elif verb in REMOVE:
            for held in (tasks, nodes, leases):
                held.pop(t, None)
            failed.discard(t)
            edges = {k: v for k, v in edges.items() if t not in v}
    return {"tasks": tasks, "nodes": nodes, "edges": edges, "leases": leases, "failed": failed}
