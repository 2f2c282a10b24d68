"""Run analytics: aggregations over nodes and edges, one result set per graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.functions.scalars import error_class, js_round, normalised
from graphloom.schema import GraphFrames

BINS = 12


def _ms(name: str = "dur_analytics") -> Column:
    return M.DURATIONS[name]


def status_histogram(g: GraphFrames) -> DataFrame:
    """Counts by status bucket; cached counts as success, an unknown status is in no bucket."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    out = g.nodes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("total_nodes"), is_("success", "cached").alias("success_nodes"), is_("error").alias("error_nodes"),
        is_("running").alias("running_nodes"), is_("skipped").alias("skipped_nodes"), is_("pending").alias("pending_nodes"),
    )
    done = F.col("success_nodes") + F.col("error_nodes")
    return out.withColumn("completed_nodes", done).withColumn("success_rate", F.when(done > 0, F.col("success_nodes") / done * 100).otherwise(0.0))


def kpi_scorecard(g: GraphFrames, with_path: bool = True) -> DataFrame:
    """Executive scorecard of 23 measures. Here warnings count as failures; statuses never recorded count nowhere.

    Health: 100 less 0.45 a percent of failures, 0.12 a point of the bottleneck score, 10 an open critical and 4 an open
    important finding, and 10 where repair rounds recovered less than half.
    """
    from graphloom.operators import paths

    zero = F.lit(0.0)
    n = g.nodes.select(
        "graph_id", "status", M.DURATIONS["dur_report"].alias("ms"), F.coalesce(M.m["tokens_in"], M.m["tokens"]["prompt"], zero).alias("prompt"),
        F.coalesce(M.m["tokens_out"], M.m["tokens"]["completion"], zero).alias("completion"), F.coalesce(M.m["tokens"]["reasoning"], zero).alias("reasoning"), M.m["cost_usd"].alias("cost"),
        F.coalesce(M.m["retries"], zero).alias("retries"), F.coalesce(M.meta("repairRounds"), M.m["repair_rounds"], zero).alias("rounds"), "findings",
    )
    is_ = lambda *s: F.count_if(F.coalesce(F.col("status").isin(*s), F.lit(False)))
    open_ = lambda sev: F.coalesce(F.sum(F.greatest(F.size(F.filter("findings", lambda f: (f["severity"] == sev) & (f["status"] == "open"))), F.lit(0))), F.lit(0))
    tried = (F.col("retries") > 0) | (F.col("rounds") > 0)
    out = n.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("total_nodes"), is_("success", "cached").alias("success"), is_("error", "warning").alias("failure"), is_("running").alias("running"), is_("pending").alias("pending"), is_("skipped").alias("skipped"),
        F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"), F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"), F.sum("reasoning").alias("reasoning_tokens"),
        js_round(F.sum("cost"), 4).alias("total_cost"), F.coalesce(js_round(F.avg(F.when(tried & (F.col("ms") > 0), F.col("ms")))), F.lit(0)).cast("double").alias("mttr_ms"), F.sum("retries").alias("total_retries"), F.sum("rounds").alias("total_rounds"),
        F.count_if(tried & F.coalesce(F.col("status").isin("success", "cached"), F.lit(False))).alias("recovered"), open_("critical").alias("open_critical"), open_("important").alias("open_important"),
    )
    out = out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens") + F.col("reasoning_tokens"))
    out = out.withColumn("failure_rate", js_round(F.col("failure") / F.col("total_nodes") * 100, 1))
    out = out.withColumn("throughput", F.when(F.col("total_ms") > 0, js_round((F.col("success") + F.col("failure")) / (F.col("total_ms") / 1000), 2)).otherwise(zero))
    out = out.withColumn("bottleneck_score", F.when(F.col("total_ms") > 0, F.least(F.lit(100.0), js_round(F.col("max_ms") / F.col("total_ms") * 120))).otherwise(zero))
    attempts = F.when((F.col("total_retries") > 0) | (F.col("total_rounds") > 0), F.col("recovered") + F.col("failure")).otherwise(F.lit(0))
    efficiency = F.when(attempts > 0, F.col("recovered") / F.nullif(attempts, F.lit(0)) * 100).otherwise(F.when(F.col("failure") == 0, 100.0).otherwise(0.0))
    out = out.withColumn("recovery_efficiency", js_round(efficiency).cast("double"))
    health = 100 - F.col("failure_rate") * 0.45 - F.col("bottleneck_score") * 0.12 - 10 * F.col("open_critical") - 4 * F.col("open_important") - F.when((F.col("total_rounds") > 0) & (F.col("recovery_efficiency") < 50), 10).otherwise(0)
    out = out.withColumn("health", F.greatest(F.lit(0), F.least(F.lit(100), js_round(health))).cast("long")).drop("max_ms", "recovered")
    edges = g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total_edges"))
    out = out.join(edges, "graph_id", "left").withColumn("total_edges", F.coalesce("total_edges", F.lit(0)))
    if with_path:
        path = paths.critical_path(g, "report").groupBy("graph_id").agg(F.sum("ms").alias("critical_ms"), F.count(F.lit(1)).alias("critical_nodes"))
        out = out.join(path, "graph_id", "left")
    return out


def token_attribution(g: GraphFrames, by: str = "model") -> DataFrame:
    """Tokens and recorded cost by model, tier, section or node, with the share of all tokens; cost stays null unless recorded."""
    keys = {"model": M.MODEL_REPORT, "tier": M.TIER, "section": F.coalesce("section_id", F.lit("unassigned")), "node": F.col("id")}
    n = g.nodes.select("graph_id", keys[by].alias("key"), M.TOKENS["tok_report_attr"].alias("tok"), M.COST.alias("cost"))
    out = n.groupBy("graph_id", "key").agg(F.count(F.lit(1)).alias("nodes"), F.sum("tok").alias("tokens"), F.sum("cost").alias("cost"))
    all_ = F.sum("tokens").over(Window.partitionBy("graph_id"))
    return out.withColumn("share", F.when(all_ > 0, js_round(F.col("tokens") / all_ * 100, 1)).otherwise(0.0)).withColumn("cost", js_round(F.col("cost"), 4))


def token_measures(g: GraphFrames) -> DataFrame:
    """Nine measures by model: nodes, five token roles, total, cost, share."""
    n = g.nodes.select("graph_id", M.MODEL.alias("model"), M.PROMPT.alias("prompt"), M.COMPLETION.alias("completion"), M.REASONING.alias("reasoning"), M.CREATION.alias("creation"), M.CACHE_READ.alias("cache_read"), M.TOKENS["tok_analytics"].alias("total"), M.COST.alias("cost"))
    sums = [F.sum(c).alias(c) for c in ("prompt", "completion", "reasoning", "creation", "cache_read", "total", "cost")]
    out = n.groupBy("graph_id", "model").agg(F.count(F.lit(1)).alias("nodes"), *sums)
    all_ = F.sum("total").over(Window.partitionBy("graph_id"))
    return out.withColumn("share", F.when(all_ > 0, F.col("total") / all_ * 100).otherwise(0.0))


def tokens_by_role(g: GraphFrames) -> DataFrame:
    """Token sums unpivoted by role."""
    roles = ["prompt", "completion", "reasoning", "creation", "cache_read"]
    wide = token_measures(g).groupBy("graph_id").agg(*[F.sum(c).alias(c) for c in roles])
    return wide.unpivot("graph_id", roles, "role", "tokens")


def tokens_by_tier(g: GraphFrames) -> DataFrame:
    """By tier in a fixed order (place), tiers without nodes left out."""
    out = g.nodes.groupBy("graph_id", M.TIER.alias("tier")).agg(F.count(F.lit(1)).alias("nodes"), F.sum(M.TOKENS["tok_analytics"]).alias("tokens"))
    return out.withColumn("place", F.array_position(F.array(*map(F.lit, ("xs", "s", "m", "l", "unspecified"))), F.col("tier")).cast("int"))


def phase_velocity(g: GraphFrames) -> DataFrame:
    """Per step: nodes, longest duration, tokens, recorded cost, whether any failed, nodes a minute."""
    n = g.nodes.select("graph_id", F.coalesce("step", F.lit(1.0)).alias("step"), _ms().alias("ms"), M.TOKENS["tok_analytics"].alias("tok"), M.COST.alias("cost"), "status")
    out = n.groupBy("graph_id", "step").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("ms").alias("ms"), F.sum("tok").alias("tokens"), F.sum("cost").alias("cost"),
        F.bool_or(F.coalesce(F.col("status") == "error", F.lit(False))).alias("has_errors"),
    )
    return out.withColumn("velocity", F.when(F.col("ms") > 0, F.col("nodes") / (F.col("ms") / 60_000)).otherwise(F.col("nodes") * 60.0))


def step_extremes(g: GraphFrames) -> DataFrame:
    """Fastest and slowest step; of equals the later."""
    p = phase_velocity(g)
    return p.groupBy("graph_id").agg(
        F.max(F.struct("velocity", "step"))["step"].alias("fastest_step"), F.max(F.struct((-F.col("velocity")).alias("v"), "step"))["step"].alias("slowest_step"),
        F.avg("ms").alias("avg_step_ms"),
    )


def concurrency_bins(g: GraphFrames) -> DataFrame:
    """Nodes in twelve equal bins of the step range, empty bins included, against the fullest step."""
    n = g.nodes.select("graph_id", F.coalesce("step", F.lit(1.0)).alias("step"))
    w = Window.partitionBy("graph_id")
    n = n.withColumn("lo", F.min("step").over(w)).withColumn("hi", F.max("step").over(w))
    place = F.floor((F.col("step") - F.col("lo")) / F.greatest(F.lit(1.0), F.col("hi") - F.col("lo") + 1) * BINS)
    n = n.withColumn("bin", F.least(F.lit(BINS - 1), place).cast("int"))
    most = n.groupBy("graph_id", "step").count().groupBy("graph_id").agg(F.max("count").alias("most"))
    spine = most.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    out = spine.join(n.groupBy("graph_id", "bin").agg(F.count(F.lit(1)).alias("active")), ["graph_id", "bin"], "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return out.withColumn("intensity", F.least(F.lit(1.0), F.col("active") / F.col("most"))).select("graph_id", "bin", "active", "intensity")


def repair_histogram(g: GraphFrames) -> DataFrame:
    """Nodes with 0, 1, 2 and 3 or more repair rounds, all four there, and the share that needed none."""
    n = g.nodes.select("graph_id", M.REPAIRS.alias("rounds"))
    all_ = n.groupBy("graph_id").agg(F.count_if(F.col("rounds") == 0).alias("first_pass"), F.count(F.lit(1)).alias("total"), F.max("rounds").alias("max_rounds"), F.sum("rounds").alias("total_rounds"))
    spine = all_.withColumn("rounds", F.explode(F.sequence(F.lit(0), F.lit(3))))
    bins = n.groupBy("graph_id", F.least("rounds", F.lit(3)).cast("int").alias("rounds")).agg(F.count(F.lit(1)).alias("nodes"))
    out = spine.join(bins, ["graph_id", "rounds"], "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    return out.withColumn("first_pass_rate", F.col("first_pass") / F.col("total") * 100).drop("total")


def error_messages(g: GraphFrames) -> DataFrame:
    """Every error said anywhere: findings, failed commands, failed nodes that record neither, rejected exchanges (of their
    source)."""
    n, no = g.nodes, F.lit(False)
    findings = n.select("graph_id", "id", "ord", F.posexplode("findings").alias("pos", "f"))
    findings = findings.select("graph_id", "id", "ord", "pos", F.concat_ws(" ", "f.observation", "f.remediation").alias("message"), F.coalesce(F.col("f.status") == "resolved", no).alias("resolved"))
    commands = n.select("graph_id", "id", "ord", F.posexplode("commands").alias("pos", "c")).filter("c.exit_code <> 0")
    commands = commands.select("graph_id", "id", "ord", "pos", F.coalesce("c.stderr", F.concat(F.lit("Exit code "), F.col("c.exit_code"))).alias("message"), no.alias("resolved"))
    bare = n.filter("status = 'error'").filter((F.coalesce(F.size("findings"), F.lit(0)) <= 0) & (F.coalesce(F.size("commands"), F.lit(0)) <= 0))
    bare = bare.select("graph_id", "id", "ord", F.lit(0).alias("pos"), F.coalesce("logs", "badge_text", F.concat(F.col("name"), F.lit(" encountered error"))).alias("message"), no.alias("resolved"))
    said = g.edges.select("graph_id", "source", "target", "ord", F.posexplode("exchanges").alias("pos", "x")).filter("x.status = 'error' or x.verdict = 'FAIL' or x.type = 'rejection'")
    said = said.select("graph_id", F.col("source").alias("id"), "ord", "pos", F.coalesce("x.summary", F.concat_ws(" -> ", F.concat(F.lit("Exchange rejection on "), F.col("source")), "target")).alias("message"), no.alias("resolved"))
    return findings.unionByName(commands).unionByName(bare).unionByName(said)


def error_taxonomy(g: GraphFrames) -> DataFrame:
    """By error class: errors, distinct nodes, unresolved, the first three messages in input order."""
    e = error_messages(g).withColumn("error_class", error_class(F.col("message")))
    nth = F.row_number().over(Window.partitionBy("graph_id", "error_class").orderBy("ord", "pos"))
    e = e.withColumn("sample", F.when(nth <= 3, F.struct(nth.alias("nth"), "message")))
    out = e.groupBy("graph_id", "error_class").agg(F.count(F.lit(1)).alias("errors"), F.countDistinct("id").alias("nodes"), F.count_if(~F.col("resolved")).alias("unresolved"), F.array_sort(F.collect_list("sample")).alias("s"))
    return out.withColumn("samples", F.col("s.message")).drop("s")


def run_velocity(g: GraphFrames, critical_ms: DataFrame | None = None) -> DataFrame:
    """Rates over the wall clock: the critical path (graph_id, critical_ms) where given and not 0, else all durations."""
    t = F.coalesce(M.m["timing_breakdown"], M.m["timing"])
    n = g.nodes.select("graph_id", "status", _ms().alias("ms"), F.coalesce(t["think"], t["cognitive"], F.lit(0.0)).alias("think"), F.coalesce(t["tool"], t["active_command"], F.lit(0.0)).alias("tool"), M.TOKENS["tok_analytics"].alias("tok"))
    out = n.groupBy("graph_id").agg(F.sum("ms").alias("sum_ms"), F.sum("think").alias("think_ms"), F.sum("tool").alias("tool_ms"), F.sum("tok").alias("tokens"), F.count_if(F.col("status").isin("success", "cached", "error")).alias("done"), F.count(F.lit(1)).alias("nodes"))
    out = out.join(critical_ms, "graph_id", "left") if critical_ms is not None else out.withColumn("critical_ms", F.lit(None).cast("double"))
    wall = F.when(F.coalesce("critical_ms", F.lit(0.0)) > 0, F.col("critical_ms")).otherwise(F.col("sum_ms"))
    out = out.withColumn("wall_ms", wall).withColumn("overhead_ms", F.greatest(F.lit(0.0), F.col("wall_ms") - F.col("think_ms") - F.col("tool_ms")))
    part = lambda c: F.when(F.col("wall_ms") > 0, F.least(F.lit(100.0), F.col(c) / F.col("wall_ms") * 100)).otherwise(0.0)
    rate = lambda c, unit: F.when(F.col("wall_ms") > 0, F.col(c) / (F.col("wall_ms") / unit)).otherwise(0.0)
    return out.select(
        "graph_id", "wall_ms", part("think_ms").alias("cognitive_percent"), part("tool_ms").alias("tool_percent"), part("overhead_ms").alias("overhead_percent"),
        rate("done", 60_000).alias("nodes_per_minute"), rate("tokens", 1000).alias("tokens_per_second"),
        F.when(F.col("wall_ms") > 0, F.col("sum_ms") / F.col("wall_ms")).otherwise(1.0).alias("average_concurrency"),
    )


def path_efficiency(g: GraphFrames, critical_ms: DataFrame) -> DataFrame:
    """Queue wait, parallel efficiency and the critical path's share of all durations."""
    s = g.nodes.groupBy("graph_id").agg(F.sum(_ms()).alias("sum_ms"), F.count(F.lit(1)).alias("nodes")).join(critical_ms, "graph_id")
    ratio = F.when(F.col("sum_ms") > 0, F.col("critical_ms") / F.col("sum_ms")).otherwise(0.0)
    return s.select("graph_id", F.greatest(F.lit(0.0), F.col("sum_ms") - F.col("critical_ms")).alias("queue_wait_ms"), F.least(F.lit(100.0), ratio * 100).alias("parallel_efficiency"), ratio.alias("critical_ratio"))


def bottleneck_ranking(g: GraphFrames) -> DataFrame:
    """Nodes ranked by duration, input order for ties, with the share of all durations and a running sum."""
    n = g.nodes.select("graph_id", "ord", "id", _ms().alias("ms"))
    w = Window.partitionBy("graph_id").orderBy(F.desc("ms"), "ord")
    all_ = F.sum("ms").over(Window.partitionBy("graph_id"))
    out = n.withColumn("place", F.row_number().over(w)).withColumn("share", F.when(all_ > 0, F.col("ms") / all_ * 100).otherwise(0.0))
    return out.withColumn("running_ms", F.sum("ms").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("ord")


def outliers(g: GraphFrames, sigma: float = 2.5, least: int = 3, duration: str = "dur_anomaly") -> DataFrame:
    """Nodes whose duration exceeds the mean of the positive ones by ``sigma`` population deviations, given ``least`` of them."""
    w = Window.partitionBy("graph_id")
    n = g.nodes.select("graph_id", "id", _ms(duration).alias("ms")).filter("ms > 0")
    n = n.withColumns({"mean": F.avg("ms").over(w), "deviation": F.stddev_pop("ms").over(w), "samples": F.count("ms").over(w)})
    return n.filter((F.col("samples") >= least) & (F.col("deviation") > 0) & (F.col("ms") > F.col("mean") + sigma * F.col("deviation")))


def pareto(g: GraphFrames, share: float = 0.2) -> DataFrame:
    """Nodes by tokens, nulls last, and whether each is in the top fifth (one at least) with tokens at all."""
    n = g.nodes.select("graph_id", "ord", "id", M.TOKENS["tok_lens"].alias("tokens"))
    w = Window.partitionBy("graph_id")
    n = n.withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last("tokens"), "ord"))).withColumn("of", F.count(F.lit(1)).over(w))
    top = (F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("of") * share))) & (F.coalesce("tokens", F.lit(0.0)) > 0)
    return n.select("graph_id", "id", "tokens", "place", top.alias("is_pareto"))


def ecdf(g: GraphFrames) -> DataFrame:
    """Share of the graph's nodes that take at most as long."""
    n = g.nodes.select("graph_id", "id", _ms().alias("ms"))
    return n.withColumn("ecdf", F.cume_dist().over(Window.partitionBy("graph_id").orderBy("ms")))


def medians(g: GraphFrames) -> DataFrame:
    """The true median, and the upper one, of durations."""
    n = g.nodes.select("graph_id", _ms().alias("ms"))
    out = n.groupBy("graph_id").agg(F.expr("percentile(ms, 0.5)").alias("median"), F.array_sort(F.collect_list("ms")).alias("s"))
    return out.select("graph_id", "median", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("upper_median"))


def lens_summary(g: GraphFrames) -> DataFrame:
    n = g.nodes.select("graph_id", _ms("dur_heatmap").alias("ms"))
    return n.groupBy("graph_id").agg(F.min("ms").alias("least"), F.max("ms").alias("most"), F.avg("ms").alias("mean"), F.sum("ms").alias("total"), F.count(F.lit(1)).alias("nodes"))


def recorded_totals(g: GraphFrames) -> DataFrame:
    """Sums of what was recorded, null if nothing was, with the number of nodes that report."""
    n = g.nodes.select("graph_id", M.DURATIONS["dur_recorded"].alias("ms"), M.TOKENS["tok_search"].alias("tok"), M.COST.alias("cost"))
    return n.groupBy("graph_id").agg(*[f(c).alias(f"{k}_{c}") for c in ("ms", "tok", "cost") for k, f in (("total", F.sum), ("reporting", F.count))])


def review_activity(g: GraphFrames) -> DataFrame:
    """Probe and pushback edges with their exchanges; ``has_record`` if there is any."""
    e = g.edges.select("graph_id", F.lower(F.coalesce("kind", F.lit(""))).alias("kind"), F.coalesce(F.size("exchanges"), F.lit(0)).alias("n"))
    probe, push = F.col("kind") == "probe", F.col("kind").isin("pushback", "loop")
    out = e.groupBy("graph_id").agg(F.count_if(probe).alias("probe_edges"), F.count_if(push).alias("pushback_edges"), F.sum(F.when(probe, F.greatest("n", F.lit(1))).otherwise(0)).alias("probe_rounds"), F.sum(F.when(push, F.greatest("n", F.lit(1))).otherwise(0)).alias("pushback_rounds"))
    return out.withColumn("has_record", F.col("probe_edges") + F.col("pushback_edges") > 0)


def facets(g: GraphFrames) -> DataFrame:
    """Which features a graph uses at all."""
    has = lambda c: F.bool_or(F.col(c).isNotNull())
    some = lambda c: F.bool_or(F.coalesce(F.size(c), F.lit(0)) > 0)
    return g.nodes.groupBy("graph_id").agg(has("status").alias("status"), has("step").alias("steps"), has("section_id").alias("sections"), has("model").alias("models"), some("tools").alias("tools"), some("findings").alias("findings"), F.bool_or(M.COST.isNotNull()).alias("costs"), F.bool_or(M.TOKENS["tok_search"].isNotNull()).alias("tokens"))


def unknown_fields(g: GraphFrames) -> DataFrame:
    """Keys of the open parts (scope, key): nodes that have them and a first sample, most frequent first by place."""
    parts = [g.nodes.select("graph_id", "id", "ord", F.lit(scope).alias("scope"), F.explode(F.from_json(F.col(scope), "map<string,string>")).alias("key", "value")) for scope in ("extras", "metadata", "context")]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = all_.groupBy("graph_id", "scope", "key").agg(F.countDistinct("id").alias("nodes"), F.min_by("value", "ord").alias("sample"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("nodes"), "key", "scope")))


def playback_steps(g: GraphFrames) -> DataFrame:
    """Steps of nodes and of edges alone; status by precedence error, running, success, else pending."""
    n = g.nodes.filter("step is not null").select("graph_id", "step", "status", "step_label", F.lit(1).alias("is_node"))
    e = g.edges.select("graph_id", F.col("step_number").try_cast("double").alias("step"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("step_label"), F.lit(0).alias("is_node")).filter("step is not null")
    has = lambda *s: F.bool_or(F.coalesce(F.col("status").isin(*s), F.lit(False)))
    out = n.unionByName(e).groupBy("graph_id", "step").agg(F.sum("is_node").alias("nodes"), F.sum(1 - F.col("is_node")).alias("edges"), F.max("step_label").alias("label"), has("error").alias("e"), has("running").alias("r"), has("success", "cached").alias("s"))
    status = F.when(F.col("e"), "error").when(F.col("r"), "running").when(F.col("s"), "success").otherwise("pending")
    return out.select("graph_id", "step", "nodes", "edges", F.coalesce("label", F.concat(F.lit("Step "), F.col("step").cast("long"))).alias("label"), status.alias("status"))


def density_grid(boxes: DataFrame, columns: int = 8, rows: int = 6) -> DataFrame:
    """Boxes (graph_id, x, y, width, height) counted by the grid cell of their centre, against the fullest cell."""
    w = Window.partitionBy("graph_id")
    b = boxes.select("graph_id", (F.col("x") + F.coalesce("width", F.lit(120.0)) / 2).alias("cx"), (F.col("y") + F.coalesce("height", F.lit(60.0)) / 2).alias("cy"), "x", "y", F.coalesce("width", F.lit(120.0)).alias("width"), F.coalesce("height", F.lit(60.0)).alias("height"))
    b = b.withColumns({"x0": F.min("x").over(w), "x1": F.max(F.col("x") + F.col("width")).over(w), "y0": F.min("y").over(w), "y1": F.max(F.col("y") + F.col("height")).over(w)})
    cell = lambda c, lo, hi, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - F.col(lo)) / F.greatest(F.lit(1e-9), F.col(hi) - F.col(lo)) * n))).cast("int")
    out = b.groupBy("graph_id", cell("cx", "x0", "x1", columns).alias("col"), cell("cy", "y0", "y1", rows).alias("row")).agg(F.count(F.lit(1)).alias("boxes"))
    return out.withColumn("density", F.col("boxes") / F.max("boxes").over(w))


def heatmap(g: GraphFrames, scale: str = "linear") -> DataFrame:
    """Durations normalised within the graph on a linear, log, sqrt or quantile scale."""
    w = Window.partitionBy("graph_id")
    n = g.nodes.select("graph_id", "id", _ms("dur_heatmap").alias("ms"))
    n = n.withColumns({"lo": F.min("ms").over(w), "hi": F.max("ms").over(w), "q": F.cume_dist().over(w.orderBy("ms"))})
    return n.select("graph_id", "id", "ms", normalised(F.col("ms"), F.col("lo"), F.col("hi"), scale, F.col("q")).alias("heat"))


# Weights of the risk factors.
RISK_WEIGHTS = {"status": 0.3, "retries": 0.25, "findings": 0.2, "commands": 0.15, "complexity": 0.05, "blast": 0.05}


def node_risk(g: GraphFrames, weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """Weighted risk of six factors in [0, 1]: status, retries, open findings, failed commands, complexity, fan-out."""
    outs = g.edges.groupBy("graph_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    n = g.nodes.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("graph_id"))).join(outs, ["graph_id", "id"], "left")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    many = lambda a, f: F.greatest(F.coalesce(F.size(F.filter(a, f)), F.lit(0)), F.lit(0))
    status = F.when(F.col("status") == "error", 1.0).when(F.col("status") == "warning", 0.6).when(F.col("status") == "running", 0.2).when(F.col("status") == "pending", 0.1).when(F.col("status") == "skipped", 0.05).otherwise(0.0)
    tries = M.REPAIRS_RISK + F.coalesce(M.meta("repairRounds"), F.lit(0.0)) + many("provenance", lambda e: e["status"].isin("error", "rejected"))
    critical, open_ = many("findings", lambda f: (f["status"] == "open") & (f["severity"] == "critical")), many("findings", lambda f: f["status"] == "open")
    failed = many("commands", lambda c: c["exit_code"] != 0)
    hard = F.when(F.col("telemetry.model_tier.value") == "l", 0.4).otherwise(0.0) + F.when(F.col("host_agent.reasoning_effort") == "high", 0.3).otherwise(0.0) + F.when(F.size("tools") > 4, 0.3).otherwise(0.0)
    factors = {
        "status": status, "retries": F.when(tries >= 3, 1.0).otherwise(unit(tries * 0.35)), "findings": unit(critical * 0.5 + (open_ - critical) * 0.2),
        "commands": F.when(failed > 0, unit(0.5 + failed * 0.25)).otherwise(0.0), "complexity": unit(hard), "blast": unit(F.coalesce("out_degree", F.lit(0)) / F.greatest(F.lit(1.0), F.col("size") * 0.3)),
    }
    n = n.select("graph_id", "id", *[c.alias(f"{k}_risk") for k, c in factors.items()])
    whole = sum(weights.values())
    raw = sum((F.col(f"{k}_risk") * w for k, w in weights.items()), F.lit(0.0))
    n = n.withColumn("risk", js_round(raw / whole, 4) if whole else F.lit(0.0))
    level = F.when(F.col("risk") >= 0.75, "critical").when(F.col("risk") >= 0.5, "high").when(F.col("risk") >= 0.25, "moderate").otherwise("low")
    return n.withColumn("level", level)
