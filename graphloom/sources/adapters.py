"""Graphs derived from the relational test tables: one SQL text for Spark and for DuckDB, apart from a few functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import GraphFrames

_SPARK = {
    "ms": lambda a, b: f"CAST(timestampdiff(MILLISECOND, {a}, {b}) AS DOUBLE)",
    "day": lambda t: f"CAST(datediff(CAST({t} AS DATE), DATE'2020-01-01') AS DOUBLE)",
    "idiv": lambda a, b: f"({a} div {b})",
    "digest": lambda x: f"CAST(conv(substring(md5({x}), 1, 15), 16, 10) AS BIGINT)",
}
_DUCK = {
    "ms": lambda a, b: f"CAST(date_sub('millisecond', {a}, {b}) AS DOUBLE)",
    "day": lambda t: f"CAST(date_diff('day', DATE '2020-01-01', CAST({t} AS DATE)) AS DOUBLE)",
    "idiv": lambda a, b: f"({a} // {b})",
    "digest": lambda x: f"CAST('0x' || substring(md5({x}), 1, 15) AS BIGINT)",
}


def _session(d) -> tuple[str, str]:
    base = """SELECT event_id, user_id, event_type, value, props, ts, row_number() OVER w - 1 AS ord, lead(ts) OVER w AS next_ts, lead(event_id) OVER w AS next_id
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
    nodes = f"""SELECT CAST(user_id AS STRING) AS graph_id, CAST(ord AS BIGINT) AS ord, 'e' || event_id AS id, event_type || ' ' || event_id AS name,
        event_type AS kind, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'skipped' END AS status,
        {d["day"]("ts")} AS step, {d["ms"]("ts", "next_ts")} AS duration_ms, CASE WHEN event_type = 'purchase' THEN value END AS cost_usd,
        CAST(coalesce(nullif(regexp_extract(props, '([0-9]+)', 1), ''), '0') AS DOUBLE) * 100 AS tokens_in, CAST(event_id % 1000 AS DOUBLE) AS tokens_out,
        CAST(CASE WHEN event_type = 'error' THEN event_id % 5 ELSE 0 END AS DOUBLE) AS retries, 'model-' || (event_id % 3) AS model,
        CASE event_id % 4 WHEN 0 THEN 'xs' WHEN 1 THEN 's' WHEN 2 THEN 'm' ELSE 'l' END AS tier, 'day-' || CAST(CAST({d["day"]("ts")} AS BIGINT) AS STRING) AS section_id
        FROM ({base}) b"""
    edges = f"""SELECT CAST(user_id AS STRING) AS graph_id, CAST(ord AS BIGINT) AS ord, 'e' || event_id || '->e' || next_id AS id, 'e' || event_id AS source, 'e' || next_id AS target,
        'sequence' AS kind, CAST(NULL AS BOOLEAN) AS is_cycle, {d["ms"]("ts", "next_ts")} AS latency_ms, CAST(event_id % 100 AS DOUBLE) AS tokens
        FROM ({base}) b WHERE next_id IS NOT NULL"""
    return nodes, edges


def _supply(d) -> tuple[str, str]:
    # Input positions need no global sort: group and key give the nodes' order, a digest of their id that of the edges.
    nodes = """SELECT 'supply' AS graph_id, CAST(grp AS BIGINT) * 1000000000000000 + key AS ord, id, name, kind, status, CAST(grp AS DOUBLE) AS step, duration_ms,
        CAST(NULL AS DOUBLE) AS cost_usd, CAST(NULL AS DOUBLE) AS tokens_in, CAST(NULL AS DOUBLE) AS tokens_out, CAST(NULL AS DOUBLE) AS retries, CAST(NULL AS STRING) AS model, CAST(NULL AS STRING) AS tier, section_id FROM (
        SELECT 0 AS grp, CAST(r_regionkey AS BIGINT) AS key, 'r' || r_regionkey AS id, r_name AS name, 'orchestrator' AS kind, 'success' AS status, 0.0 AS duration_ms, 'r' || r_regionkey AS section_id FROM {region}
        UNION ALL SELECT 1, CAST(n_nationkey AS BIGINT), 'n' || n_nationkey, n_name, 'group', 'success', 0.0, 'r' || n_regionkey FROM {nation}
        UNION ALL SELECT 2, c_custkey, 'c' || c_custkey, c_name, 'agent', 'success', greatest(c_acctbal, 0.0), 'r' || n_regionkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        UNION ALL SELECT 3, s_suppkey, 's' || s_suppkey, s_name, 'tool', 'success', greatest(s_acctbal, 0.0), 'r' || n_regionkey FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION ALL SELECT 4, o_orderkey, 'o' || o_orderkey, 'order ' || o_orderkey, 'task', CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'pending' END, o_totalprice, CAST(NULL AS STRING) FROM {orders}
        UNION ALL SELECT 5, p_partkey, 'p' || p_partkey, p_name, 'artifact', 'success', p_retailprice, CAST(NULL AS STRING) FROM {part}) x"""
    edges = f"""SELECT 'supply' AS graph_id, {d["digest"]("source || '->' || target")} AS ord, source || '->' || target AS id, source, target, kind,
        CAST(NULL AS BOOLEAN) AS is_cycle, CAST(NULL AS DOUBLE) AS latency_ms, CAST(NULL AS DOUBLE) AS tokens FROM (
        SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS kind FROM {{nation}}
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM {{customer}}
        UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM {{supplier}}
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'sequence' FROM {{orders}}
        UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'dependency' FROM {{lineitem}}
        UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'dependency' FROM {{lineitem}}) x"""
    return nodes, edges


_BLANK = "CAST(NULL AS DOUBLE) AS cost_usd, CAST(NULL AS DOUBLE) AS tokens_in, CAST(NULL AS DOUBLE) AS tokens_out, CAST(NULL AS DOUBLE) AS retries, CAST(NULL AS STRING) AS model, CAST(NULL AS STRING) AS tier, CAST(NULL AS STRING) AS section_id"


def _transition(d) -> tuple[str, str]:
    nodes = f"""SELECT 'types' AS graph_id, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS ord, event_type AS id, event_type AS name, event_type AS kind,
        'success' AS status, CAST(NULL AS DOUBLE) AS step, CAST(count(*) AS DOUBLE) AS duration_ms, {_BLANK} FROM {{events}} GROUP BY event_type"""
    edges = f"""SELECT 'types' AS graph_id, CAST(row_number() OVER (ORDER BY source, target) - 1 AS BIGINT) AS ord, source || '->' || target AS id, source, target, 'sequence' AS kind,
        CAST(NULL AS BOOLEAN) AS is_cycle, latency_ms, CAST(n AS DOUBLE) AS tokens FROM (
        SELECT event_type AS source, next_type AS target, count(*) AS n, avg({d["ms"]("ts", "next_ts")}) AS latency_ms FROM (
            SELECT event_type, ts, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e
        WHERE next_type IS NOT NULL GROUP BY event_type, next_type) x"""
    return nodes, edges


def _handoffs(d, only: str) -> tuple[str, str]:
    block = f"c_nationkey || '-' || {d['idiv']('c_custkey', '1000')} || '-' || year(o_orderdate)"
    rows = f"SELECT {block} AS graph_id, c_custkey, c_nationkey, c_acctbal, o_orderkey, o_orderdate FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"
    nodes = f"""SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY c_custkey) - 1 AS BIGINT) AS ord, 'c' || c_custkey AS id, 'customer ' || c_custkey AS name, 'agent' AS kind,
        CASE WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'success' END AS status, CAST(c_nationkey AS DOUBLE) AS step, abs(c_acctbal) + 1 AS duration_ms, {_BLANK}
        FROM (SELECT DISTINCT graph_id, c_custkey, c_nationkey, c_acctbal FROM ({rows}) b) x"""
    edges = f"""SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY source, target) - 1 AS BIGINT) AS ord, source || '->' || target AS id, source, target, 'handoff' AS kind,
        CAST(NULL AS BOOLEAN) AS is_cycle, CAST(NULL AS DOUBLE) AS latency_ms, CAST(NULL AS DOUBLE) AS tokens FROM (
        SELECT DISTINCT graph_id, 'c' || c_custkey AS source, 'c' || next_key AS target FROM (
            SELECT graph_id, c_custkey, lead(c_custkey) OVER (PARTITION BY graph_id ORDER BY o_orderdate, o_orderkey) AS next_key FROM ({rows}) b) y
        WHERE next_key {only} c_custkey) x"""
    return nodes, edges


def _loyal(d) -> tuple[str, str]:
    """All orders, as a graph for each nation, block of 1000 customer keys and year: cyclic, and as small at any scale."""
    return _handoffs(d, "<>")


def _relay(d) -> tuple[str, str]:
    """The handoffs of ``loyal`` to larger customer keys: acyclic, with branches and joins."""
    return _handoffs(d, ">")


def _trade(d) -> tuple[str, str]:
    """One graph of all customers: from each order to the next of its nation, among every third, where both are of one month and priority."""
    nodes = f"""SELECT 'trade' AS graph_id, CAST(c_custkey AS BIGINT) AS ord, 'c' || c_custkey AS id, c_name AS name, 'agent' AS kind, 'success' AS status, CAST(c_nationkey AS DOUBLE) AS step,
        abs(c_acctbal) AS duration_ms, {_BLANK} FROM {{customer}}"""
    edges = f"""SELECT 'trade' AS graph_id, {d["digest"]("source || '->' || target")} AS ord, source || '->' || target AS id, source, target, 'handoff' AS kind,
        CAST(NULL AS BOOLEAN) AS is_cycle, CAST(NULL AS DOUBLE) AS latency_ms, CAST(NULL AS DOUBLE) AS tokens FROM (
        SELECT DISTINCT 'c' || c_custkey AS source, 'c' || next_key AS target FROM (
            SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey, o_orderpriority, year(o_orderdate), month(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS next_key
            FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0) y WHERE next_key IS NOT NULL) x"""
    return nodes, edges


def _conversation(d) -> tuple[str, str]:
    nodes = f"""SELECT CAST(conv_id AS STRING) AS graph_id, turn AS ord, 't' || turn AS id, role || ' ' || turn AS name, role AS kind,
        'success' AS status, CAST(turn AS DOUBLE) AS step, CAST(length(text) AS DOUBLE) AS duration_ms, {_BLANK} FROM {{conversations}}"""
    edges = """SELECT CAST(conv_id AS STRING) AS graph_id, turn AS ord, 't' || turn || '->t' || next_turn AS id, 't' || turn AS source, 't' || next_turn AS target, 'handoff' AS kind,
        CAST(NULL AS BOOLEAN) AS is_cycle, CAST(NULL AS DOUBLE) AS latency_ms, CAST(NULL AS DOUBLE) AS tokens FROM (
        SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM {conversations}) x WHERE next_turn IS NOT NULL"""
    return nodes, edges


_GRAPHS = {"session": _session, "supply": _supply, "transition": _transition, "loyal": _loyal, "relay": _relay, "trade": _trade, "conversation": _conversation}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: By graph, tables that grow and are joined with larger ones: both sides shuffle, as the size of compressed files says little.
_SHUFFLED = dict.fromkeys(("loyal", "relay", "trade"), ("customer",))


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, shuffled: tuple[str, ...] = ()) -> DataFrame:
    """Run SQL whose tables are named in braces over the Parquet tables of a folder; joins of ``shuffled`` ones broadcast nothing."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: df.hint("merge") if t in shuffled else df for t, df in used.items()})


def flat(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _GRAPHS[name](_SPARK)
    return tuple(spark_sql(spark, sf_dir, sql, _SHUFFLED.get(name, ())) for sql in (nodes, edges))


def graph(spark: SparkSession, sf_dir: str, name: str) -> GraphFrames:
    """A derived graph in the common schema."""
    nodes, edges = flat(spark, sf_dir, name)
    metrics = F.struct("duration_ms", "cost_usd", "tokens_in", "tokens_out", "retries")
    traffic = F.struct(F.col("latency_ms").alias("avg_latency_ms"), F.col("tokens"))
    return GraphFrames.of(nodes.withColumn("metrics", metrics), edges.withColumn("traffic", traffic))


def duck(sql: str) -> str:
    """The text for DuckDB: table names without braces."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def ctes(name: str) -> str:
    """``nodes AS (...), edges AS (...)`` of a derived graph for DuckDB."""
    nodes, edges = _GRAPHS[name](_DUCK)
    return f"nodes AS ({duck(nodes)}), edges AS ({duck(edges)})"


def spark_functions() -> dict:
    return _SPARK


def duck_functions() -> dict:
    return _DUCK
