"""Parameterised graph changes as table transformations, with versions for undo."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import EDGES, NODES, GraphFrames, conform

FILTERS: dict[str, Callable[[str], str]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "capitalize": str.capitalize}


def substitute(text: str, values: dict, now: str = "", index: int = 0) -> str:
    """``{{name | filter}}``, ``${name || 'default'}``, $now and $index."""

    def braces(m: re.Match) -> str:
        name, *filters = (x.strip() for x in m[1].split("|"))
        out = str(values.get(name, ""))
        for f in filters:
            out = FILTERS.get(f, lambda x: x)(out)
        return out

    def dollar(m: re.Match) -> str:
        name, _, other = (x.strip() for x in m[1].partition("||"))
        return str(values[name]) if values.get(name) not in (None, "") else other.strip("'\"")

    text = re.sub(r"\$\{([^}]*)\}", dollar, re.sub(r"\{\{([^}]*)\}\}", braces, text))
    return text.replace("$now", now).replace("$index", str(index))


def check_parameters(spec: dict[str, dict], values: dict) -> list[str]:
    """Problems of parameter values: missing, of another type, out of range or not an option."""
    out = []
    for name, s in spec.items():
        v = values.get(name, s.get("default"))
        if v is None:
            out += [f"{name} is missing"] if s.get("required") else []
            continue
        if s.get("type") == "number" and not isinstance(v, (int, float)):
            out.append(f"{name} is not a number")
        elif s.get("type") == "number" and not s.get("min", v) <= v <= s.get("max", v):
            out.append(f"{name} is out of range")
        if s.get("options") and v not in s["options"]:
            out.append(f"{name} is not an option")
    return out


def _here(graph_id: str, id_: str, column: str = "id") -> Column:
    return (F.col("graph_id") == graph_id) & (F.col(column) == id_)


def apply(g: GraphFrames, action: str, graph_id: str, **a) -> GraphFrames:
    """One action: create_, update_, delete_ node or edge, set_status, set_kind, set_section, add_tag, retarget_edge,
    reverse_edge, clear_edges, rename_node, duplicate_node, merge_metrics."""
    n, e, spark = g.nodes, g.edges, g.nodes.sparkSession
    id_ = a.get("id")
    here = _here(graph_id, id_) if id_ is not None else None

    def new(ddl: str, **values):
        values = {k: v for k, v in values.items() if v is not None}
        return conform(spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]), ddl)

    def patched(df, **values):
        for k, v in values.items():
            df = df.withColumn(k, F.when(here, F.lit(v).cast(df.schema[k].dataType)).otherwise(F.col(f"`{k}`")))
        return df

    rest = {k: v for k, v in a.items() if k != "id"}
    if action == "create_node":  # replaces a node of the same id
        n = n.filter(~here).unionByName(new(NODES, graph_id=graph_id, ord=1 << 40, id=id_, **{"name": id_, **rest}))
    elif action in ("update_node", "set_status", "set_kind", "set_section", "rename_node"):
        n = patched(n, **rest)
    elif action == "delete_node":  # with its edges
        n, e = n.filter(~here), e.filter(~((F.col("graph_id") == graph_id) & ((F.col("source") == id_) | (F.col("target") == id_))))
    elif action == "create_edge":
        edge_id = id_ or f"{a['source']}->{a['target']}"
        e = e.filter(~_here(graph_id, edge_id)).unionByName(new(EDGES, graph_id=graph_id, ord=1 << 40, **{"kind": "dependency", **rest, "id": edge_id}))
    elif action in ("update_edge", "retarget_edge"):
        e = patched(e, **rest)
    elif action == "delete_edge":
        gone = here if id_ is not None else _here(graph_id, a["source"], "source") & (F.col("target") == a["target"])
        e = e.filter(~gone)
    elif action == "reverse_edge":
        e = e.withColumn("s", F.col("source")).withColumn("source", F.when(here, F.col("target")).otherwise(F.col("source"))).withColumn("target", F.when(here, F.col("s")).otherwise(F.col("target"))).drop("s")
    elif action == "clear_edges":
        e = e.filter(~((F.col("graph_id") == graph_id) & ((F.col("source") == id_) | (F.col("target") == id_))))
    elif action == "duplicate_node":
        n = n.unionByName(n.filter(here).withColumn("id", F.lit(a["new_id"])).withColumn("ord", F.lit(1 << 40).cast("bigint")))
    elif action == "merge_metrics":
        m = F.col("metrics")
        for k, v in rest.items():
            m = m.withField(k, F.lit(float(v)))
        n = n.withColumn("metrics", F.when(here, m).otherwise(F.col("metrics")))
    elif action == "add_badge":
        one = F.array(F.struct(F.lit(a["label"]).alias("label"), F.lit(a.get("variant")).cast("string").alias("variant")))
        n = n.withColumn("badges", F.when(here, F.concat(F.coalesce("badges", F.expr("cast(array() as array<struct<label:string,variant:string>>)")), one)).otherwise(F.col("badges")))
    else:
        raise ValueError(f"unknown action {action}")
    return GraphFrames(n, e, g.sections)


@dataclass
class Editor:
    """Versions of a graph: run actions, step back and forth, jump, reset. Versions are plans, not copies."""

    versions: list[GraphFrames]
    at: int = 0
    log: list[str] = field(default_factory=list)

    def run(self, action: str, graph_id: str, **arguments) -> GraphFrames:
        self.versions[self.at + 1 :] = [apply(self.versions[self.at], action, graph_id, **arguments)]
        self.log[self.at :] = [action]
        self.at += 1
        return self.versions[self.at]

    def jump(self, to: int) -> GraphFrames:
        self.at = max(0, min(to, len(self.versions) - 1))
        return self.versions[self.at]

    def undo(self) -> GraphFrames:
        return self.jump(self.at - 1)

    def redo(self) -> GraphFrames:
        return self.jump(self.at + 1)


def batch_update(g: GraphFrames, where: Column, **values) -> GraphFrames:
    """Set columns of all nodes that match."""
    n = g.nodes
    for k, v in values.items():
        n = n.withColumn(k, F.when(F.coalesce(where, F.lit(False)), F.lit(v).cast(n.schema[k].dataType)).otherwise(F.col(f"`{k}`")))
    return GraphFrames(n, g.edges, g.sections)


@dataclass(frozen=True)
class Macro:
    """A named list of actions whose arguments may hold parameters."""

    name: str
    parameters: dict[str, dict]
    steps: list[dict]

    def to_json(self) -> str:
        return json.dumps({"version": 1, "name": self.name, "parameters": self.parameters, "steps": self.steps}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Macro:
        x = json.loads(text)
        if x.get("version") != 1 or not isinstance(x.get("steps"), list) or not all("action" in s for s in x["steps"]):
            raise ValueError("not a macro")
        return Macro(x["name"], x.get("parameters") or {}, x["steps"])

    def run(self, g: GraphFrames, graph_id: str, values: dict | None = None, now: str = "") -> GraphFrames:
        """The graph after all steps; parameters are checked first."""
        values = {k: s["default"] for k, s in self.parameters.items() if "default" in s} | (values or {})
        if problems := check_parameters(self.parameters, values):
            raise ValueError("; ".join(problems))
        for i, step in enumerate(self.steps):
            arguments = {k: substitute(v, values, now, i) if isinstance(v, str) else v for k, v in step.items() if k != "action"}
            g = apply(g, step["action"], graph_id, **arguments)
        return g


class Registry:
    """Macros by name; a later one of the same name replaces the earlier."""

    def __init__(self, macros: list[Macro] = ()):
        self.macros = {m.name: m for m in macros}

    def add(self, macro: Macro) -> None:
        self.macros[macro.name] = macro

    def find(self, text: str) -> list[Macro]:
        return [m for n, m in sorted(self.macros.items()) if text.lower() in n.lower()]
