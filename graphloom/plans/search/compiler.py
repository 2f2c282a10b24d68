"""From a parsed query to (match, score) Columns over the nodes and edges of graphs.

Predicates are two-valued: a null field matches only != and !in. Arrays match if any element does, and != if none does.
Scores: exact 10, contains 8, similar up to 10 (~) or 6 (:), != and NOT 5; AND adds, OR takes the best; a bare term adds
over all text fields by weight.
"""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import js_round, similarity
from graphloom.plans.search.dictionary import FIELDS, completions
from graphloom.plans.search.parser import Node, parse
from graphloom.schema import GraphFrames

SPLIT = r"[\s\-_.,/]+"


def _texts(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))


def _meta_list(path: str) -> Column:
    return F.coalesce(F.expr(f"try_variant_get(try_parse_json(metadata), '$.{path}', 'array<string>')"), F.expr("cast(array() as array<string>)"))


def _of(array: str, f) -> Column:
    return F.coalesce(F.filter(F.transform(array, f), lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)"))


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


# The names by which a search addresses a field of a node or an edge.
@functools.lru_cache
def node_fields() -> dict[tuple[str, ...], Column]:
    """Field names (without case, dashes and underscores) and what they read from a node."""
    m = M.m
    return {
        ("id",): _col("id"),
        ("name", "label", "title"): _col("name"),
        ("description", "desc"): _col("description"),
        ("type", "kind", "archetype"): _texts(_col("kind"), _col("type"), M.label(M.KIND)),
        ("status", "state"): _texts(_col("status"), M.STATUS, M.label(M.STATUS)),
        ("step", "stepnumber", "round"): F.coalesce(_col("step"), M.meta("round")),
        ("steplabel",): _col("step_label"),
        ("model", "llm", "harnessmodel"): _texts(_col("model"), _col("harness_model"), F.col("host_agent.model")),
        ("tier",): _texts(_col("tier"), F.col("host_agent.tier")),
        ("effort", "reasoningeffort", "thinking", "thinkinglevel"): _texts(F.col("host_agent.reasoning_effort"), F.col("host_agent.thinking_level")),
        ("priority", "rank"): F.coalesce(_col("rank").cast("string"), _col("group")),
        ("section", "sectionid", "group"): _texts(_col("section_id"), _col("group")),
        ("scope", "writescope", "files", "file", "path"): F.concat(_meta_list("writeScope"), _of("files", lambda f: f["path"]), _texts(M.meta("repoPath", "string", "context"))),
        ("tool", "tools"): _of("tools", lambda t: t["name"]),
        ("badge", "badges"): F.concat(_texts(_col("badge_text")), _of("badges", lambda b: b["label"])),
        ("duration", "durationms", "time", "latency"): M.DURATIONS["dur_search"],
        ("tokens", "totaltokens", "token"): M.TOKENS["tok_search"],
        ("tokensin", "prompttokens", "inputtokens"): F.coalesce(m["tokens_in"], m["tokens"]["prompt"]),
        ("tokensout", "completiontokens", "outputtokens"): F.coalesce(m["tokens_out"], m["tokens"]["completion"]),
        ("cost", "costusd"): m["cost_usd"],
        ("retries", "repairs", "repairrounds"): F.coalesce(m["retries"], m["repair_rounds"], M.meta("repairRounds")),
        ("actor", "actorid", "agent", "leaseagent"): _texts(M.meta("leaseAgent", "string"), F.col("host_agent.name"), M.meta("actorId", "string")),
        ("severity",): _of("findings", lambda f: f["severity"]),
        ("finding", "findings", "observation", "remediation"): F.concat(_of("findings", lambda f: f["observation"]), _of("findings", lambda f: f["remediation"]), _of("findings", lambda f: f["id"])),
        ("prompt",): _col("prompt"),
        ("output",): _col("output"),
        ("logs", "log"): _col("logs"),
    }


@functools.lru_cache
def edge_fields() -> dict[tuple[str, ...], Column]:
    return {
        ("id",): _col("id"),
        ("source", "from"): _col("source"),
        ("target", "to"): _col("target"),
        ("label", "title"): _texts(_col("label"), F.col("container.title")),
        ("description", "desc"): _col("description"),
        ("kind", "type"): _texts(_col("kind"), F.col("container.variant")),
        ("condition",): _col("condition"),
        ("status",): F.col("traffic.status"),
        ("volume", "traffic", "trafficvolume"): F.coalesce(_col("traffic_volume"), F.col("traffic.volume")),
        ("tokens",): F.coalesce(_col("tokens"), F.col("traffic.tokens")),
        ("bytes",): F.col("traffic.bytes"),
        ("severity",): _of("exchanges", lambda x: x["severity"]),
    }


#: Fields with numbers; all others are texts.
NUMERIC = {"step", "stepnumber", "round", "duration", "durationms", "time", "latency", "tokens", "totaltokens", "token", "tokensin", "prompttokens", "inputtokens", "tokensout", "completiontokens", "outputtokens", "cost", "costusd", "retries", "repairs", "repairrounds", "volume", "traffic", "trafficvolume", "bytes"}
ARRAYS = {"type", "kind", "archetype", "status", "state", "model", "llm", "harnessmodel", "tier", "effort", "reasoningeffort", "thinking", "thinkinglevel", "section", "sectionid", "group", "scope", "writescope", "files", "file", "path", "tool", "tools", "badge", "badges", "actor", "actorid", "agent", "leaseagent", "severity", "finding", "findings", "observation", "remediation"}
EDGE_ARRAYS = {"label", "title", "kind", "type", "severity"}

# The text fields that a bare term searches, and their weights.
NODE_TERMS = (("name", 10), ("id", 8), ("steplabel", 7), ("type", 6), ("status", 6), ("model", 6), ("description", 5), ("badge", 5), ("tools", 5), ("writescope_only", 5), ("files_only", 4), ("prompt", 3), ("output", 3), ("logs", 2))
EDGE_TERMS = (("id", 8), ("label", 10), ("source", 7), ("target", 7), ("kind", 6), ("condition", 5), ("description", 5))


def _lookup(table: dict[tuple[str, ...], Column]) -> dict[str, Column]:
    return {name: c for names, c in table.items() for name in names}


class Compiler:
    """Compiles for one entity; ``custom`` maps further field names to Columns (arrays if ``array_fields`` names them)."""

    def __init__(self, entity: str, threshold: float = 0.75, case_sensitive: bool = False, custom: dict[str, Column] | None = None, empty_matches: bool = True):
        self.node = entity == "node"
        self.fields = _lookup(node_fields() if self.node else edge_fields())
        if self.node:
            self.fields |= {"writescope_only": _meta_list("writeScope"), "files_only": _of("files", lambda f: f["path"])}
        self.arrays = (ARRAYS | {"writescope_only", "files_only"}) if self.node else EDGE_ARRAYS
        self.custom, self.threshold, self.case, self.empty = custom or {}, threshold, case_sensitive, empty_matches

    def resolve(self, name: str) -> tuple[Column, str]:
        """A field's Column and kind: number, array or string; unknown names are paths into the open parts."""
        plain = name.lower().replace("-", "").replace("_", "")
        if name in self.custom:
            return self.custom[name], "string"
        if plain in self.fields:
            return self.fields[plain], "number" if plain in NUMERIC else "array" if plain in self.arrays else "string"
        scopes = ("extras", "metadata", "context") if self.node else ("extras",)
        safe = "".join(c for c in name if c.isalnum() or c in "._")
        return F.coalesce(*[M.meta(safe, "string", s) for s in scopes]), "string"

    # ---- one value

    def _fold(self, c: Column) -> Column:
        return c if self.case else F.lower(c)

    def scalar(self, t: Column, kind: str, op: str, n: Node) -> Column:
        """Score of a non-null value, null where it doesn't match."""
        ten = F.lit(10.0)
        if kind == "number" and n.value_kind in ("number", "range", "set"):
            if n.value_kind == "number":
                v = F.lit(float(n.value))
                hit = {"!=": t != v, ">": t > v, ">=": t >= v, "<": t < v, "<=": t <= v}.get(op, t == v)
            elif n.value_kind == "range":
                hit = (t >= n.value[0]) & (t <= n.value[1] if n.value[1] is not None else F.lit(True))
            else:
                from graphloom.plans.search.lexer import parse_number

                numbers = [x for x in map(parse_number, n.value) if x is not None]
                hit = t.isin(numbers) if numbers else F.lit(False)
                hit = ~hit if op in ("!in", "!=") else hit
            return F.when(hit, ten)
        text = t.cast("string") if kind == "number" else t
        if kind == "number":  # whole numbers without a fraction
            text = F.when(t == F.floor(t), t.cast("long").cast("string")).otherwise(text)
        if n.value_kind == "regex":
            pattern, flags = n.value
            return F.when(text.rlike(("" if self.case and "i" not in flags else "(?i)") + pattern), ten)
        low = self._fold(text)
        if n.value_kind == "set":
            items = [x if self.case else x.lower() for x in n.value]
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in items], F.lit(False))
            return F.when(~hit if op in ("!in", "!=") else hit, ten)
        said = n.value if n.value_kind == "string" else f"{n.value:g}" if n.value_kind == "number" else ""
        want = said if self.case else said.lower()
        v = F.lit(want)
        if op == "=":
            return F.when(low == v, ten)
        if op == "!=":
            return F.when(low != v, F.lit(5.0))
        parts = F.filter(F.split(low, SPLIT), lambda w: w != "")
        if op == "~":
            whole = similarity(low, v)
            best = F.coalesce(F.array_max(F.transform(parts, lambda w: similarity(w, v))), F.lit(0.0))
            return F.when(whole >= self.threshold, js_round(whole * 10)).when(best >= self.threshold, js_round(best * 10))
        out = F.when(low == v, ten).when(F.contains(low, v), F.lit(8.0))
        if len(want) > 2 and self.threshold < 1:
            near = F.filter(F.transform(F.filter(parts, lambda w: F.length(w) > 1), lambda w: similarity(w, v)), lambda s: s >= self.threshold)
            first = F.try_element_at(near, F.lit(1))
            out = out.when(first.isNotNull(), js_round(first * 6))
        return out

    def predicate(self, field: Column, kind: str, n: Node) -> tuple[Column, Column]:
        """(match, score), never null."""
        negative = n.op in ("!=", "!in")
        if kind == "array":
            op = {"!=": "=", "!in": "in"}.get(n.op, n.op)
            hits = F.filter(F.transform(field, lambda x: self.scalar(x, "string", op, n)), lambda s: s.isNotNull())
            if negative:
                none = F.size(hits) == 0
                return F.coalesce(none, F.lit(True)), F.coalesce(F.when(none, 5.0), F.lit(0.0))
            some = F.coalesce(F.size(hits) > 0, F.lit(False))
            return some, F.when(some, F.aggregate(hits, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
        score = self.scalar(field, kind, n.op, n)
        match = F.when(field.isNull(), F.lit(negative)).otherwise(score.isNotNull())
        return match, F.coalesce(score, F.lit(0.0))

    def compile(self, n: Node) -> tuple[Column, Column]:
        if n.kind == "empty":
            return F.lit(self.empty), F.lit(1.0 if self.empty else 0.0)
        if n.kind == "field":
            return self.predicate(*self.resolve(n.name), n)
        if n.kind == "term":
            one = [(self.predicate(*self.resolve(name), n), weight) for name, weight in (NODE_TERMS if self.node else EDGE_TERMS)]
            match = _balanced([x for (x, _), _ in one], lambda a, b: a | b)
            return match, _balanced([s * (w / 10) for (_, s), w in one], lambda a, b: a + b)
        parts = [self.compile(p) for p in n.parts]
        if n.kind == "not":
            match = ~parts[0][0]
            return match, F.when(match, 5.0).otherwise(0.0)
        if n.kind == "and":
            match = _balanced([x for x, _ in parts], lambda a, b: a & b)
            return match, F.when(match, _balanced([s for _, s in parts], lambda a, b: a + b)).otherwise(0.0)
        match = _balanced([x for x, _ in parts], lambda a, b: a | b)
        return match, F.greatest(*[F.when(x, s).otherwise(0.0) for x, s in parts])

    def highlights(self, n: Node) -> Column:
        """Spans (field, start, end, text) of contained and matching words in scalar text fields."""
        spans = []

        def walk(p: Node) -> None:
            names = [p.name] if p.kind == "field" else [f for f, _ in (NODE_TERMS if self.node else EDGE_TERMS)] if p.kind == "term" else []
            for name in names:
                field, kind = self.resolve(name)
                if kind == "string" and p.value_kind in ("string", "regex") and p.op not in ("!=", "!in") and p.value:
                    if p.value_kind == "regex":
                        found = F.regexp_substr(field, F.lit("(?i)" + p.value[0]))
                        at = F.regexp_instr(field, F.lit("(?i)" + p.value[0])) - 1
                        length = F.length(found)
                    else:
                        at = F.instr(F.lower(field), p.value.lower()) - 1
                        length = F.lit(len(p.value))
                    span = F.struct(F.lit(name).alias("field"), at.cast("int").alias("start"), (at + length).cast("int").alias("end"), F.substr(field, at + 1, length).alias("text"))
                    spans.append(F.when(at >= 0, span))
            if p.kind != "not":
                for q in p.parts:
                    walk(q)

        walk(n)
        empty = F.expr("cast(array() as array<struct<field:string,start:int,end:int,text:string>>)")
        return F.filter(F.array(*spans), lambda s: s.isNotNull()) if spans else empty


def _balanced(xs: list[Column], f) -> Column:
    """A tree of logarithmic depth instead of a chain."""
    while len(xs) > 1:
        xs = [f(*xs[i : i + 2]) if len(xs[i : i + 2]) == 2 else xs[i] for i in range(0, len(xs), 2)]
    return xs[0]


def search(g: GraphFrames, query: str, nodes: bool = True, edges: bool = True, highlights: bool = False, **options) -> DataFrame:
    """Matches (graph_id, entity, ord, id, score), best first and then by input order."""
    tree, _ = parse(query)
    parts = []
    for entity, df in (("node", g.nodes if nodes else None), ("edge", g.edges if edges else None)):
        if df is not None:
            c = Compiler(entity, **options)
            match, score = c.compile(tree)
            more = [c.highlights(tree).alias("highlights")] if highlights else []
            parts.append(df.filter(match).select("graph_id", F.lit(entity).alias("entity"), "ord", "id", score.alias("score"), *more))
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("score"), "graph_id", F.desc("entity"), "ord")


# Names that completion offers.
OPERATOR_HINTS = (":", "=", "!=", ">", ">=", "<", "<=", "~", ":in(")


def suggest(g: GraphFrames, text: str, limit: int = 10, dictionary: DataFrame | None = None) -> list[tuple[str, str]]:
    """Completions (kind, text) at the end of a query: fields, operators after a field, values seen in the data.

    With a stored ``dictionary`` the values of its fields come from a range of it, the most frequent first; without one, and
    for other fields, the graphs are read.
    """
    word = text.split()[-1] if text and not text[-1].isspace() else ""
    fields = sorted({names[0] for names in node_fields()} | {names[0] for names in edge_fields()})
    for op in (":", "=", "~", ">", "<"):
        name, sep, begun = word.partition(op)
        if sep:
            if dictionary is not None and name.lower().replace("-", "").replace("_", "") in FIELDS:
                return [("value", r.value) for r in completions(dictionary, name, begun, limit).collect()]
            field, kind = Compiler("node").resolve(name)
            values = g.nodes.select((F.explode(field) if kind == "array" else field.cast("string")).alias("v")).filter(F.col("v").isNotNull() & F.startswith(F.lower("v"), F.lit(begun.lower())))
            return [("value", r.v) for r in values.distinct().orderBy("v").limit(limit).collect()]
    if word in fields:
        return [("operator", word + o) for o in OPERATOR_HINTS][:limit]
    return [("field", f) for f in fields if f.startswith(word.lower())][:limit]
