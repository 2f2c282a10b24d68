"""Queries of number and text functions over values derived from the tables, and of edge bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import layout
from graphloom.queries.registry import query, rounded
from graphloom.sources.adapters import ctes, duck, graph, spark_sql

_MEASURES = "SELECT o_orderkey, CAST((o_orderkey * 7919 + 1) % 9000011 AS DOUBLE) AS ms, CAST((o_orderkey * 104729 + 1) % 3000017 AS DOUBLE) AS n, CAST((o_orderkey * 2 + 1) % 4000 AS DOUBLE) / 10000 AS usd FROM {orders}"


@query(f"""WITH m AS ({duck(_MEASURES)}), k AS (SELECT o_orderkey, CASE WHEN ms % 100 = 50 THEN ms + 1 ELSE ms END AS ms, CASE WHEN n % 100000 = 50000 OR n % 100 = 50 THEN n + 1 ELSE n END AS n, usd FROM m)
    SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms::BIGINT || 'ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000) || 's' WHEN ms < 3600000 THEN floor(ms / 60000)::BIGINT || 'm ' || floor(ms / 1000 % 60 + 0.5)::BIGINT || 's'
        ELSE floor(ms / 3600000)::BIGINT || 'h ' || floor(ms / 1000 % 3600 / 60)::BIGINT || 'm' END AS duration,
    CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1000000) || 'M' WHEN n >= 1000 THEN printf('%.1f', n / 1000) || 'k' ELSE n::BIGINT::VARCHAR END AS tokens, '$' || CASE WHEN usd < 0.01 THEN printf('%.4f', usd) ELSE printf('%.2f', usd) END AS cost FROM k""")
def formatted_values(spark, sf_dir):
    """Durations, tokens and costs as texts; halves, which languages round differently, are moved."""
    m = spark_sql(spark, sf_dir, _MEASURES)
    ms, n = F.when(F.col("ms") % 100 == 50, F.col("ms") + 1).otherwise(F.col("ms")), F.when((F.col("n") % 100000 == 50000) | (F.col("n") % 100 == 50), F.col("n") + 1).otherwise(F.col("n"))
    return m.select("o_orderkey", scalars.format_duration(ms).alias("duration"), scalars.format_tokens(n).alias("tokens"), scalars.format_cost(F.col("usd")).alias("cost"))


_READ = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat(event_id, '.5ms') WHEN 1 THEN concat('-', event_id, 'e2x') WHEN 2 THEN concat('x', event_id) WHEN 3 THEN concat('  .', event_id) WHEN 4 THEN '' WHEN 5 THEN NULL ELSE concat('+', event_id) END AS text FROM {events}"


@query(f"""WITH r AS ({duck(_READ)}), v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_id + 0.5 WHEN 1 THEN -event_id * 100.0 WHEN 3 THEN ('0.' || event_id)::DOUBLE WHEN 6 THEN event_id END::DOUBLE AS number FROM r)
    SELECT event_id, round(number, 6) AS number, round(least(greatest(coalesce(number, 7.0), -5000.0), 5000.0), 6) AS bounded FROM v""")
def lenient_numbers(spark, sf_dir):
    """The numbers that texts begin with, and the same with a fallback and bounds."""
    number = scalars.leading_number(F.col("text"))
    return rounded(spark_sql(spark, sf_dir, _READ).select("event_id", number.alias("number"), scalars.sanitised(number, 7, -5000, 5000).alias("bounded")), 6)


_AGENTS = "SELECT event_id, concat(CASE user_id % 8 WHEN 0 THEN 'Root' WHEN 1 THEN 'code-Review' WHEN 2 THEN 'my-val' WHEN 3 THEN 'HARNESS' WHEN 4 THEN 'user' WHEN 5 THEN 'devops' WHEN 6 THEN 'coordinator-review' ELSE 'x' END, '-', user_id) AS agent_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' WHEN 'view' THEN 'critic_approved' ELSE event_type END AS type, event_id % 9 AS attempt FROM {events}"


@query(f"""WITH a AS ({duck(_AGENTS)}) SELECT event_id, CASE split_part(lower(agent_id), '-', 1) WHEN 'root' THEN 'orchestrator' WHEN 'code' THEN 'critic' WHEN 'my' THEN 'validator' WHEN 'harness' THEN 'system' WHEN 'user' THEN 'user' WHEN 'coordinator' THEN 'orchestrator' ELSE 'implementer' END AS role,
    CASE type WHEN 'error' THEN 'reject' WHEN 'warn' THEN 'warn' WHEN 'critic_approved' THEN 'approve' ELSE 'info' END AS severity,
    list_reduce(list_prepend(0::BIGINT, list_transform(string_split(agent_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS accent, least(30000.0, 1000.0 * 2 ** attempt)::DOUBLE AS delay_ms FROM a""")
def agent_traits(spark, sf_dir):
    """Roles and severities told by names, stable accents, reconnect delays."""
    a = spark_sql(spark, sf_dir, _AGENTS)
    return a.select("event_id", scalars.inferred_role(F.col("agent_id")).alias("role"), scalars.inferred_severity(F.col("type")).alias("severity"), scalars.rolling_hash(F.col("agent_id")).alias("accent"), scalars.backoff_delay(F.col("attempt")).alias("delay_ms"))


@query(f"""WITH {ctes("loyal")}, x AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target)
    SELECT graph_id, a, b, count(*) AS edges, count(*) FILTER (source = a) AS forward, count(*) FILTER (source <> a) AS backward, count(*)::DOUBLE AS weight, arg_min(id, ord) AS first FROM x GROUP BY 1, 2, 3""")
def edge_bundles(spark, sf_dir):
    return layout.bundles(graph(spark, sf_dir, "loyal"))
