"""Span profiling: tree, self times, interval unions, peak concurrency, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import stage

# Closed vocabularies; other members become the fallback.
TIERS, TIER = ("root", "coordinator", "subagent", "worker", "tool", "gate", "system"), "subagent"
STATUSES, STATUS = ("pending", "running", "success", "error", "cancelled"), "success"
CATEGORIES, CATEGORY = ("agent_cascade", "llm_call", "tool_execution", "task_lease", "validator_gate", "custom"), "agent_cascade"


def normalise(spans: DataFrame) -> DataFrame:
    """Ends never before starts; unknown members of the vocabularies replaced; duration added."""
    known = lambda c, members, other: F.when(F.col(c).isin(*members), F.col(c)).otherwise(F.lit(other))
    s = spans.withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    s = s.withColumns({"tier": known("tier", TIERS, TIER), "status": known("status", STATUSES, STATUS), "category": known("category", CATEGORIES, CATEGORY)})
    return s.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def tree(spans: DataFrame) -> DataFrame:
    """Depth, root and self time. A span whose parent is missing is a root, and so is the first of a parent cycle."""
    s = stage(normalise(spans), "spans")
    known = s.select("graph_id", F.col("id").alias("parent_id"))
    s = s.join(known.withColumn("has", F.lit(True)).distinct(), ["graph_id", "parent_id"], "left")
    s = s.withColumn("parent_id", F.when(F.col("has") & (F.col("parent_id") != F.col("id")), F.col("parent_id"))).drop("has")
    children = s.filter("parent_id is not null").groupBy("graph_id", F.col("parent_id").alias("id")).agg(F.sum("duration_ms").alias("below"), F.count(F.lit(1)).alias("children"))
    links = stage(s.filter("parent_id is not null").select("graph_id", F.col("parent_id").alias("src"), F.col("id").alias("dst")), "links")
    front = stage(s.filter("parent_id is null").select("graph_id", "id", F.col("id").alias("root"), F.lit(0).alias("depth")), "front")
    seen, depth = front, 0
    while True:
        depth += 1
        step = front.select("graph_id", F.col("id").alias("src"), "root").join(links, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id"), "root", F.lit(depth).alias("depth"))
        front = stage(step, "front")
        if front.isEmpty():
            lost = s.join(seen, ["graph_id", "id"], "left_anti")
            first = lost.groupBy("graph_id").agg(F.min_by("id", "ord").alias("id"))
            front = stage(first.select("graph_id", "id", F.col("id").alias("root"), F.lit(0).alias("depth")), "front")
            if front.isEmpty():
                break
            depth = 0
            links = stage(links.join(front.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_anti"), "links")
        seen = seen.unionByName(front)
    out = s.join(seen, ["graph_id", "id"]).join(children, ["graph_id", "id"], "left").fillna(0, ["below", "children"])
    return out.withColumn("self_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - F.col("below"))).drop("below")


def active_time(spans: DataFrame) -> DataFrame:
    """Length of the union of the intervals, by gaps and islands; touching intervals join."""
    s = normalise(spans)
    w = Window.partitionBy("graph_id").orderBy("start_ms", "end_ms", "id")
    s = s.withColumn("reach", F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start_ms") > F.col("reach")), 1).otherwise(0)).over(w))
    islands = s.groupBy("graph_id", "island").agg((F.max("end_ms") - F.min("start_ms")).alias("ms"))
    return islands.groupBy("graph_id").agg(F.sum("ms").alias("active_ms"), F.count(F.lit(1)).alias("islands"))


def peak_concurrency(spans: DataFrame) -> DataFrame:
    """Most spans at once; an end comes before a start at the same time, and the peak is 1 at least."""
    s = normalise(spans)
    points = s.select("graph_id", F.col("start_ms").alias("t"), F.lit(1).alias("d")).unionByName(s.select("graph_id", F.col("end_ms").alias("t"), F.lit(-1).alias("d")))
    points = points.groupBy("graph_id", "t", "d").agg(F.sum("d").alias("n"))
    run = F.sum("n").over(Window.partitionBy("graph_id").orderBy("t", "d"))
    return points.withColumn("open", run).groupBy("graph_id").agg(F.greatest(F.max("open"), F.lit(1)).alias("peak"))


def metrics(spans: DataFrame) -> DataFrame:
    """Counts, extent, percentiles with linear interpolation, tokens and recorded cost."""
    p = lambda q: F.expr(f"percentile(duration_ms, {q})")
    return normalise(spans).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("spans"), (F.max("end_ms") - F.min("start_ms")).alias("extent_ms"), F.sum("duration_ms").alias("total_ms"),
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost"),
    )


def counts(spans: DataFrame, by: str = "status") -> DataFrame:
    """Spans by status, tier or category, members without spans included."""
    members = {"status": STATUSES, "tier": TIERS, "category": CATEGORIES}[by]
    s = normalise(spans)
    spine = s.select("graph_id").distinct().withColumn("member", F.explode(F.array(*map(F.lit, members))))
    n = s.groupBy("graph_id", F.col(by).alias("member")).agg(F.count(F.lit(1)).alias("spans"))
    return spine.join(n, ["graph_id", "member"], "left").fillna(0, ["spans"])


def by_agent(spans: DataFrame) -> DataFrame:
    s = normalise(spans)
    return s.groupBy("graph_id", "agent_id").agg(F.count(F.lit(1)).alias("spans"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"), F.sum("tokens").alias("tokens"), F.count_if(F.col("status") == "error").alias("errors"))


def select(spans: DataFrame, statuses=None, tiers=None, categories=None, text: str = "", least_ms: float = 0) -> DataFrame:
    """Spans of the given members, at least so long, with the text in name, agent or id."""
    s = normalise(spans).filter(F.col("duration_ms") >= least_ms)
    for c, members in (("status", statuses), ("tier", tiers), ("category", categories)):
        s = s.filter(F.col(c).isin(*members)) if members else s
    said = F.lower(F.concat_ws(" ", "name", "agent_id", "id"))
    return s.filter(F.contains(said, F.lit(text.lower()))) if text else s
