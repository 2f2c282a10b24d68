"""Lenses: a value per node, normalised, filtered by a threshold, coloured; and quick filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import js_round, normalised
from graphloom.operators import analytics, paths
from graphloom.schema import GraphFrames

# Colours of the ramps from low to high.
RAMPS = {"heat": ("#2c7bb6", "#abd9e9", "#ffffbf", "#fdae61", "#d7191c"), "mono": ("#f7fbff", "#08306b")}


def ramp(t: Column, name: str = "heat") -> Column:
    """The colour at t in [0, 1] as #rrggbb, interpolated between neighbours."""
    stops = [tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in RAMPS[name]]
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    low = F.least(F.floor(at), F.lit(len(stops) - 2))
    parts = []
    for k in range(3):
        table = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.get(table, low.cast("int")), F.get(table, low.cast("int") + 1)
        parts.append(F.lower(F.lpad(F.hex(js_round(a + (b - a) * (at - low)).cast("long")), 2, "0")))
    return F.concat(F.lit("#"), *parts)


def evaluate(g: GraphFrames, lens: str = "heatmap", scale: str = "linear", threshold: float = 0.0, colours: str = "heat") -> DataFrame:
    """Value, normalised value and colour of each node; those under the threshold are hidden; null values are neutral."""
    if lens == "critical":
        values = paths.schedule(g).select("graph_id", "id", F.col("bottleneck").alias("value"))
    elif lens == "risk":
        values = analytics.node_risk(g).select("graph_id", "id", F.col("risk").alias("value"))
    else:
        values = g.nodes.select("graph_id", "id", {"heatmap": M.DURATIONS["dur_heatmap"], "tokens": M.TOKENS["tok_lens"]}[lens].alias("value"))
    w = Window.partitionBy("graph_id")
    v = values.withColumns({"lo": F.min("value").over(w), "hi": F.max("value").over(w), "q": F.cume_dist().over(w.orderBy("value"))})
    level = F.when(F.col("value").isNotNull(), normalised(F.col("value"), F.col("lo"), F.col("hi"), scale, F.col("q")))
    v = v.withColumn("level", level)
    return v.select("graph_id", "id", "value", "level", (F.coalesce("level", F.lit(0.0)) >= threshold).alias("is_shown"), ramp(F.coalesce("level", F.lit(0.0)), colours).alias("colour"))


# Role groups of the quick filters.
ROLE_GROUPS = {"planning": ("orchestrator", "coordinator", "planner"), "execution": ("implementer", "worker", "tester"), "review": ("critic", "validator", "reviewer")}


def quick_filter(name: str) -> Column:
    """all, errors, success, tools, a role group, or role:<id>."""
    role = F.coalesce("telemetry.role", M.meta("role", "string"), F.col("kind"))
    if name == "all":
        return F.lit(True)
    if name in ROLE_GROUPS:
        hit = role.isin(*ROLE_GROUPS[name])
    elif name.startswith("role:"):
        hit = role == name[5:]
    else:
        hit = {"errors": M.STATUS.isin("error", "warning"), "success": M.STATUS.isin("success", "cached"), "tools": (F.size("tools") > 0) | (F.col("kind") == "tool")}[name]
    return F.coalesce(hit, F.lit(False))


def filter_diff(d: DataFrame, statuses=None, changed=None, text: str = "") -> DataFrame:
    """Rows of a diff by status, by a changed property, or by a part of the id."""
    d = d.filter(F.col("status").isin(*statuses)) if statuses else d
    d = d.filter(F.array_contains("changed", changed)) if changed else d
    return d.filter(F.contains(F.lower("id"), F.lit(text.lower()))) if text else d


def value_shape(json_text: Column) -> Column:
    """The shape of an unknown value: its inferred schema."""
    return F.schema_of_variant(F.try_parse_json(json_text))


def human_key(key: Column) -> Column:
    """A field name as words: camel case and separators split, first letter in capitals."""
    words = F.trim(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))
