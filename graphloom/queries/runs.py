"""Queries of run analytics, search, risk and anomalies over the session graphs (a graph per user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import metrics as M
from graphloom.operators import analytics as A
from graphloom.operators import anomaly
from graphloom.plans.search import search
from graphloom.queries.registry import query, rounded
from graphloom.sources.adapters import ctes, graph

S = "WITH " + ctes("session")
_G = "graph_id"


def session(spark, sf_dir):
    return graph(spark, sf_dir, "session")


@query(f"""{S} SELECT graph_id, count(*) AS total_nodes, count(*) FILTER (status IN ('success', 'cached')) AS success_nodes, count(*) FILTER (status = 'error') AS error_nodes,
    count(*) FILTER (status = 'running') AS running_nodes, count(*) FILTER (status = 'skipped') AS skipped_nodes, count(*) FILTER (status = 'pending') AS pending_nodes,
    count(*) FILTER (status IN ('success', 'cached', 'error')) AS completed_nodes,
    round(CASE WHEN count(*) FILTER (status IN ('success', 'cached', 'error')) > 0 THEN count(*) FILTER (status IN ('success', 'cached')) / count(*) FILTER (status IN ('success', 'cached', 'error'))::DOUBLE * 100 ELSE 0 END, 4) AS success_rate
    FROM nodes GROUP BY graph_id""")
def status_histogram(spark, sf_dir):
    return rounded(A.status_histogram(session(spark, sf_dir)))


@query(f"""{S}, k AS (SELECT graph_id, count(*) AS total_nodes, count(*) FILTER (status IN ('success', 'cached')) AS success, count(*) FILTER (status IN ('error', 'warning')) AS failure,
    count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'skipped') AS skipped,
    sum(CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END) AS total_ms, max(CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END) AS max_ms, sum(tokens_in) AS prompt_tokens, sum(tokens_out) AS completion_tokens, sum(cost_usd) AS total_cost,
    coalesce(floor(avg(duration_ms) FILTER (retries > 0 AND duration_ms > 0) + 0.5), 0) AS mttr_ms, sum(retries) AS total_retries, count(*) FILTER (retries > 0 AND status = 'success') AS recovered FROM nodes GROUP BY graph_id),
    r AS (SELECT *, floor(failure / total_nodes::DOUBLE * 100 * 10 + 0.5) / 10 AS failure_rate, CASE WHEN total_ms > 0 THEN floor((success + failure) / (total_ms / 1000) * 100 + 0.5) / 100 ELSE 0 END AS throughput,
    CASE WHEN total_ms > 0 THEN least(100.0, floor(max_ms / total_ms * 120 + 0.5)) ELSE 0.0 END AS bottleneck_score,
    CASE WHEN total_retries > 0 AND recovered + failure > 0 THEN floor(recovered / (recovered + failure)::DOUBLE * 100 + 0.5) WHEN failure = 0 THEN 100 ELSE 0 END AS recovery_efficiency FROM k),
    e AS (SELECT graph_id, count(*) AS total_edges FROM edges GROUP BY 1)
    SELECT r.graph_id, total_nodes, success, failure, running, pending, skipped, round(total_ms, 4) AS total_ms, round(prompt_tokens, 4) AS prompt_tokens, round(completion_tokens, 4) AS completion_tokens, 0.0::DOUBLE AS reasoning_tokens,
    round(total_cost, 2) AS total_cost, mttr_ms, total_retries, 0.0::DOUBLE AS total_rounds, 0::BIGINT AS open_critical, 0::BIGINT AS open_important, round(prompt_tokens + completion_tokens, 4) AS total_tokens, round(failure_rate, 4) AS failure_rate,
    round(throughput, 4) AS throughput, bottleneck_score, recovery_efficiency, greatest(0, least(100, floor(100 - failure_rate * 0.45::DOUBLE - bottleneck_score * 0.12::DOUBLE + 0.5)))::BIGINT AS health, coalesce(total_edges, 0) AS total_edges FROM r LEFT JOIN e USING (graph_id)""")
def kpi_scorecard(spark, sf_dir):
    return rounded(A.kpi_scorecard(session(spark, sf_dir), with_path=False).withColumn("total_cost", F.round("total_cost", 2)))


def _attribution(key: str) -> str:
    return f"""{S}, a AS (SELECT graph_id, {key} AS key, count(*) AS nodes, sum(tokens_in + tokens_out) AS tokens, sum(CASE WHEN cost_usd IS NOT NULL THEN greatest(cost_usd, 0) END) AS cost FROM nodes GROUP BY 1, 2)
    SELECT graph_id, key, nodes, round(tokens, 4) AS tokens, round(cost, 2) AS cost, round(CASE WHEN sum(tokens) OVER g > 0 THEN floor(tokens / sum(tokens) OVER g * 100 * 10 + 0.5) / 10 ELSE 0 END, 4) AS share
    FROM a WINDOW g AS (PARTITION BY graph_id)"""


@query(_attribution("model"))
def tokens_by_model(spark, sf_dir):
    return rounded(A.token_attribution(session(spark, sf_dir), "model").withColumn("cost", F.round("cost", 2)))


@query(_attribution("section_id"))
def tokens_by_section(spark, sf_dir):
    return rounded(A.token_attribution(session(spark, sf_dir), "section").withColumn("cost", F.round("cost", 2)))


@query(f"""{S} SELECT graph_id, role, round(tokens, 4) AS tokens FROM (SELECT graph_id, sum(tokens_in) AS prompt, sum(tokens_out) AS completion, 0.0::DOUBLE AS reasoning, 0.0::DOUBLE AS creation, 0.0::DOUBLE AS cache_read FROM nodes GROUP BY 1)
    UNPIVOT (tokens FOR role IN (prompt, completion, reasoning, creation, cache_read))""")
def tokens_by_role(spark, sf_dir):
    return rounded(A.tokens_by_role(session(spark, sf_dir)))


@query(f"""{S} SELECT graph_id, tier, count(*) AS nodes, round(sum(tokens_in + tokens_out), 4) AS tokens, (CASE tier WHEN 'xs' THEN 1 WHEN 's' THEN 2 WHEN 'm' THEN 3 ELSE 4 END)::INTEGER AS place FROM nodes GROUP BY 1, 2""")
def tokens_by_tier(spark, sf_dir):
    return rounded(A.tokens_by_tier(session(spark, sf_dir)))


_PHASES = f"""{S}, p AS (SELECT graph_id, step, count(*) AS nodes, max(greatest(coalesce(duration_ms, 0), 0)) AS ms, sum(tokens_in + tokens_out) AS tokens, sum(CASE WHEN cost_usd IS NOT NULL THEN greatest(cost_usd, 0) END) AS cost, bool_or(status = 'error') AS has_errors FROM nodes GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN ms > 0 THEN nodes / (ms / 60000) ELSE nodes * 60.0 END AS velocity FROM p)"""


@query(f"{_PHASES} SELECT graph_id, step, nodes, round(ms, 4) AS ms, round(tokens, 4) AS tokens, round(cost, 4) AS cost, has_errors, round(velocity, 4) AS velocity FROM v")
def phase_velocity(spark, sf_dir):
    return rounded(A.phase_velocity(session(spark, sf_dir)))


@query(f"""{_PHASES} SELECT graph_id, arg_max(step, {{'a': velocity, 'b': step}}) AS fastest_step, arg_max(step, {{'a': -velocity, 'b': step}}) AS slowest_step, round(avg(ms), 4) AS avg_step_ms FROM v GROUP BY 1""")
def step_extremes(spark, sf_dir):
    return rounded(A.step_extremes(session(spark, sf_dir)))


@query(f"""{S}, b AS (SELECT graph_id, step, min(step) OVER g AS lo, max(step) OVER g AS hi FROM nodes WINDOW g AS (PARTITION BY graph_id)),
    n AS (SELECT graph_id, least(11, floor((step - lo) / greatest(1.0, hi - lo + 1) * 12))::INTEGER AS bin, count(*) AS active FROM b GROUP BY 1, 2),
    m AS (SELECT graph_id, max(c) AS most FROM (SELECT graph_id, step, count(*) AS c FROM nodes GROUP BY 1, 2) GROUP BY 1)
    SELECT m.graph_id, s.bin::INTEGER AS bin, coalesce(active, 0) AS active, round(least(1.0, coalesce(active, 0) / most::DOUBLE), 4) AS intensity FROM m CROSS JOIN range(12) s(bin) LEFT JOIN n ON n.graph_id = m.graph_id AND n.bin = s.bin""")
def concurrency_bins(spark, sf_dir):
    return rounded(A.concurrency_bins(session(spark, sf_dir)))


@query(f"""{S}, a AS (SELECT graph_id, count(*) FILTER (retries = 0) AS first_pass, count(*) AS total, max(floor(retries))::BIGINT AS max_rounds, sum(floor(retries))::BIGINT AS total_rounds FROM nodes GROUP BY 1),
    b AS (SELECT graph_id, least(floor(retries), 3)::INTEGER AS rounds, count(*) AS nodes FROM nodes GROUP BY 1, 2)
    SELECT a.graph_id, s.r::INTEGER AS rounds, first_pass, max_rounds, total_rounds, coalesce(nodes, 0) AS nodes, round(first_pass / total::DOUBLE * 100, 4) AS first_pass_rate FROM a CROSS JOIN range(4) s(r) LEFT JOIN b ON b.graph_id = a.graph_id AND b.rounds = s.r""")
def repair_histogram(spark, sf_dir):
    return rounded(A.repair_histogram(session(spark, sf_dir)))


@query(f"""{S} SELECT graph_id, CASE WHEN contains(name, '429') THEN 'rate_limit_quota' ELSE 'runtime_unhandled' END AS error_class, count(*) AS errors, count(DISTINCT id) AS nodes, count(*) AS unresolved FROM nodes WHERE status = 'error' GROUP BY 1, 2""")
def error_taxonomy(spark, sf_dir):
    return A.error_taxonomy(session(spark, sf_dir)).drop("samples")


@query(f"""{S}, r AS (SELECT graph_id, id, greatest(coalesce(duration_ms, 0), 0) AS ms, row_number() OVER (PARTITION BY graph_id ORDER BY greatest(coalesce(duration_ms, 0), 0) DESC, ord) AS place, sum(greatest(coalesce(duration_ms, 0), 0)) OVER (PARTITION BY graph_id) AS total FROM nodes)
    SELECT graph_id, id, ms, place, round(CASE WHEN total > 0 THEN ms / total * 100 ELSE 0 END, 4) AS share, round(sum(ms) OVER (PARTITION BY graph_id ORDER BY place), 4) AS running_ms FROM r""")
def bottleneck_ranking(spark, sf_dir):
    return rounded(A.bottleneck_ranking(session(spark, sf_dir)).withColumn("place", F.col("place").cast("long")))


@query(f"""{S}, p AS (SELECT graph_id, id, duration_ms AS ms, avg(duration_ms) OVER g AS mean, stddev_pop(duration_ms) OVER g AS deviation, count(*) OVER g AS samples FROM nodes WHERE duration_ms > 0 WINDOW g AS (PARTITION BY graph_id))
    SELECT graph_id, id, ms, round(mean, 3) AS mean, round(deviation, 3) AS deviation, samples FROM p WHERE samples >= 3 AND deviation > 0 AND ms > mean + 2.5 * deviation""")
def latency_outliers(spark, sf_dir):
    return rounded(A.outliers(session(spark, sf_dir)), 3)


@query(f"""{S}, p AS (SELECT graph_id, id, CASE WHEN tokens_in + tokens_out IS NOT NULL THEN tokens_in + tokens_out END AS tokens, row_number() OVER (PARTITION BY graph_id ORDER BY tokens_in + tokens_out DESC NULLS LAST, ord) AS place, count(*) OVER (PARTITION BY graph_id) AS n FROM nodes)
    SELECT graph_id, id, tokens, place, place <= greatest(1, ceil(n * 0.2)) AND coalesce(tokens, 0) > 0 AS is_pareto FROM p""")
def pareto_nodes(spark, sf_dir):
    return A.pareto(session(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(f"{S} SELECT graph_id, id, greatest(coalesce(duration_ms, 0), 0) AS ms, round(cume_dist() OVER (PARTITION BY graph_id ORDER BY greatest(coalesce(duration_ms, 0), 0)), 4) AS ecdf FROM nodes")
def duration_ecdf(spark, sf_dir):
    return rounded(A.ecdf(session(spark, sf_dir)))


@query(f"""{S}, d AS (SELECT graph_id, greatest(coalesce(duration_ms, 0), 0) AS ms FROM nodes)
    SELECT graph_id, quantile_cont(ms, 0.5) AS median, list_sort(list(ms))[len(list(ms)) // 2 + 1] AS upper_median FROM d GROUP BY 1""")
def duration_medians(spark, sf_dir):
    return A.medians(session(spark, sf_dir))


@query(f"""{S}, d AS (SELECT graph_id, id, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END AS ms FROM nodes), b AS (SELECT *, min(ms) OVER g AS lo, max(ms) OVER g AS hi FROM d WINDOW g AS (PARTITION BY graph_id))
    SELECT graph_id, id, ms, round(CASE WHEN hi - lo <= 0 THEN 0.5 ELSE log10(ms - lo + 1) / log10(hi - lo + 1) END, 4) AS heat FROM b""")
def heatmap_log(spark, sf_dir):
    return rounded(A.heatmap(session(spark, sf_dir), "log"))


@query(f"""{S}, d AS (SELECT graph_id, CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END AS ms FROM nodes)
    SELECT graph_id, min(ms) AS least, max(ms) AS most, round(avg(ms), 4) AS mean, round(sum(ms), 4) AS total, count(*) AS nodes FROM d GROUP BY 1""")
def lens_summary(spark, sf_dir):
    return rounded(A.lens_summary(session(spark, sf_dir)))


@query(f"""{S} SELECT graph_id, round(sum(duration_ms), 4) AS total_ms, count(duration_ms) AS reporting_ms, round(sum(CASE WHEN tokens_in + tokens_out > 0 THEN tokens_in + tokens_out END), 4) AS total_tok,
    count(CASE WHEN tokens_in + tokens_out > 0 THEN 1 END) AS reporting_tok, round(sum(CASE WHEN cost_usd IS NOT NULL THEN greatest(cost_usd, 0) END), 4) AS total_cost, count(cost_usd) AS reporting_cost FROM nodes GROUP BY 1""")
def recorded_totals(spark, sf_dir):
    return rounded(A.recorded_totals(session(spark, sf_dir)))


@query(f"""{S}, o AS (SELECT graph_id, source AS id, count(*) AS k FROM edges GROUP BY 1, 2), f AS (SELECT n.graph_id, n.id, CASE status WHEN 'error' THEN 1.0 WHEN 'warning' THEN 0.6 WHEN 'running' THEN 0.2 WHEN 'pending' THEN 0.1 WHEN 'skipped' THEN 0.05 ELSE 0.0 END::DOUBLE AS s,
    CASE WHEN retries >= 3 THEN 1.0 ELSE least(1.0, retries * 0.35) END::DOUBLE AS t, least(1.0, coalesce(k, 0) / greatest(1.0, count(*) OVER (PARTITION BY n.graph_id) * 0.3::DOUBLE)) AS b FROM nodes n LEFT JOIN o ON o.graph_id = n.graph_id AND o.id = n.id),
    r AS (SELECT graph_id, id, floor((s * 0.3::DOUBLE + t * 0.25::DOUBLE + b * 0.05::DOUBLE) * 10000 + 0.5) / 10000 AS risk FROM f)
    SELECT graph_id, id, round(risk, 3) AS risk, CASE WHEN risk >= 0.75 THEN 'critical' WHEN risk >= 0.5 THEN 'high' WHEN risk >= 0.25 THEN 'moderate' ELSE 'low' END AS level FROM r""")
def node_risk(spark, sf_dir):
    return rounded(A.node_risk(session(spark, sf_dir)).select("graph_id", "id", "risk", "level"), 3)


@query(f"""{S} SELECT graph_id, step, count(*) AS nodes, 0::BIGINT AS edges, 'Step ' || step::BIGINT AS label, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status IN ('success', 'cached')) THEN 'success' ELSE 'pending' END AS status FROM nodes GROUP BY 1, 2""")
def playback_steps(spark, sf_dir):
    return A.playback_steps(session(spark, sf_dir))


# ---- search language

_MATCH = "SELECT graph_id, 'node' AS entity, ord, id, {score} AS score FROM nodes WHERE {where}"


@query(f"{S} " + _MATCH.format(score="10.0 + 10.0 + 10.0", where="kind = 'error' AND duration_ms > 1000"))
def search_error_and_slow(spark, sf_dir):
    return search(session(spark, sf_dir), "kind=error AND duration>1s", edges=False)


@query(f"{S} " + _MATCH.format(score="greatest(CASE WHEN tokens_in + tokens_out BETWEEN 1000 AND 5000 THEN 10.0 ELSE 0.0 END, CASE WHEN cost_usd > 0.05 THEN 10.0 ELSE 0.0 END)", where="(tokens_in + tokens_out > 0 AND tokens_in + tokens_out BETWEEN 1000 AND 5000) OR coalesce(cost_usd > 0.05, false)"))
def search_ranges_or(spark, sf_dir):
    return search(session(spark, sf_dir), "tokens:1k..5k OR cost>$0.05", edges=False)


@query(f"{S} " + _MATCH.format(score="5.0", where="NOT (tokens_in + tokens_out > 1000)"))
def search_not(spark, sf_dir):
    return search(session(spark, sf_dir), "NOT tokens>1k", edges=False)


@query(f"{S} " + _MATCH.format(score="10.0 + 10.0", where="(model LIKE '%model-1%' OR model LIKE '%model-2%') AND regexp_matches(id, '^e[0-9]*7$')"))
def search_set_and_regex(spark, sf_dir):
    return search(session(spark, sf_dir), "model:in(model-1, model-2) id:/^e[0-9]*7$/", edges=False)


@query(f"{S} " + _MATCH.format(score="CASE WHEN cost_usd IS NULL THEN 0.0 ELSE 10.0 END", where="cost_usd IS NULL OR cost_usd <> 0"))
def search_null_not_equal(spark, sf_dir):
    return search(session(spark, sf_dir), "cost!=0", edges=False)


@query(f"{S} SELECT graph_id, 'edge' AS entity, ord, id, 10.0::DOUBLE AS score FROM edges WHERE tokens >= 50")
def search_edges(spark, sf_dir):
    return search(session(spark, sf_dir), "tokens>=50", nodes=False)


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'gizma' THEN 10.0 WHEN contains(lower(p_name), 'gizma') THEN 8.0
    ELSE floor(list_filter(list_transform(list_filter(string_split_regex(lower(p_name), '[\\s\\-_.,/]+'), lambda w: length(w) > 1), lambda w: 1 - levenshtein(w, 'gizma') / greatest(length(w), 5)::DOUBLE), lambda s: s >= 0.75)[1] * 6 + 0.5) END AS score
    FROM part WHERE contains(lower(p_name), 'gizma') OR len(list_filter(list_transform(list_filter(string_split_regex(lower(p_name), '[\\s\\-_.,/]+'), lambda w: length(w) > 1), lambda w: 1 - levenshtein(w, 'gizma') / greatest(length(w), 5)::DOUBLE), lambda s: s >= 0.75)) > 0""")
def search_fuzzy_words(spark, sf_dir):
    from graphloom.plans.search.compiler import Compiler
    from graphloom.plans.search.parser import Node

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    match, score = Compiler("node", custom={}).predicate(F.col("p_name"), "string", Node("field", value="gizma"))
    return part.filter(match).select("p_partkey", "p_name", score.alias("score"))


# ---- anomalies

_RETRY = f"""{S} SELECT graph_id, 'runaway_retry_loop' AS type, CASE WHEN retries >= 6 THEN 'critical' WHEN retries >= 3 THEN 'error' ELSE 'warning' END AS severity, id AS node, retries AS value FROM nodes WHERE retries > 0"""


@query(_RETRY)
def anomaly_retries(spark, sf_dir):
    out = anomaly.retry_loops(session(spark, sf_dir), anomaly.Limits())
    return out.select("graph_id", "type", "severity", F.col("node_ids")[0].alias("node"), "value")


@query(f"""{S}, t AS (SELECT graph_id, id, tokens_in + tokens_out AS tok, avg(tokens_in + tokens_out) OVER g AS mean, stddev_pop(tokens_in + tokens_out) OVER g AS dev, count(*) OVER g AS k FROM nodes WHERE tokens_in + tokens_out > 0 WINDOW g AS (PARTITION BY graph_id))
    SELECT graph_id, id AS node, tok AS value, CASE WHEN tok >= 100000 OR tok >= 4 * mean THEN 'critical' ELSE 'error' END AS severity FROM t WHERE tok >= 50000 OR (k >= 3 AND tok >= mean + 2.5 * dev AND tok > 2 * mean)""")
def anomaly_token_spikes(spark, sf_dir):
    out = anomaly.token_spikes(session(spark, sf_dir), anomaly.Limits())
    return out.select("graph_id", F.col("node_ids")[0].alias("node"), "value", "severity")


@query(f"""{S}, t AS (SELECT graph_id, id, step, ord, tokens_in + tokens_out AS tok FROM nodes WHERE tokens_in + tokens_out > 0), w AS (SELECT *, lag(tok) OVER g AS before FROM t WINDOW g AS (PARTITION BY graph_id ORDER BY step, ord))
    SELECT graph_id, tok AS value, before * 2 AS threshold FROM w WHERE tok >= 3 * before AND tok >= 500""")
def anomaly_growth(spark, sf_dir):
    return anomaly.unbounded_growth(session(spark, sf_dir), anomaly.Limits(), least=500).select("graph_id", "value", "threshold")


@query(f"""{S}, j AS (SELECT graph_id, severity, count(*) AS n FROM (SELECT graph_id, CASE WHEN retries >= 6 THEN 'critical' WHEN retries >= 3 THEN 'error' ELSE 'warning' END AS severity FROM nodes WHERE retries > 0) GROUP BY 1, 2),
    p AS (SELECT g.graph_id, coalesce(sum(n) FILTER (severity = 'critical'), 0)::BIGINT AS critical, coalesce(sum(n) FILTER (severity = 'error'), 0)::BIGINT AS error, coalesce(sum(n) FILTER (severity = 'warning'), 0)::BIGINT AS warning, 0::BIGINT AS info FROM (SELECT DISTINCT graph_id FROM nodes) g LEFT JOIN j USING (graph_id) GROUP BY 1)
    SELECT *, greatest(0, 100 - 35 * critical - 18 * error - 8 * warning)::BIGINT AS health FROM p""")
def anomaly_health(spark, sf_dir):
    g = session(spark, sf_dir)
    return anomaly.health(g, anomaly.detect(g, rules=(anomaly.retry_loops,))).withColumn("health", F.col("health").cast("long"))


@query()
def anomaly_report(spark, sf_dir):
    """All rules over the cyclic customer graph."""
    return anomaly.detect(graph(spark, sf_dir, "loyal"))


@query(f"""{S} SELECT kind, status, count(*) AS nodes, upper(kind) AS label FROM nodes GROUP BY 1, 2""")
def kind_labels(spark, sf_dir):
    return session(spark, sf_dir).nodes.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("nodes")).withColumn("label", M.label(F.col("kind")))
