"""Queries of diffs, spans, replay, telemetry, healing, collaboration and text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import collab, diff, replay, spans, textops
from graphloom.queries.registry import query, rounded
from graphloom.runtime import numbered, scratch_path
from graphloom.sources import feeds
from graphloom.sources.adapters import duck, duck_functions, spark_functions, spark_sql
from graphloom.streaming import healing, telemetry

# ---- diff: what each part shipped in odd and in even months


def _months(odd: int) -> str:
    return f"SELECT l_partkey, l_linenumber, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM {{lineitem}} WHERE month(l_shipdate) % 2 = {odd} GROUP BY 1, 2"


_BASE, _COMP = _months(1), _months(0)


@query(f"""WITH b AS ({duck(_BASE)}), c AS ({duck(_COMP)}) SELECT coalesce(b.l_partkey, c.l_partkey) AS l_partkey, coalesce(b.l_linenumber, c.l_linenumber) AS l_linenumber, b.qty AS base_qty, c.qty AS comp_qty, b.price AS base_price, c.price AS comp_price, b.n AS base_n, c.n AS comp_n,
    CASE WHEN b.l_partkey IS NULL THEN 'added' WHEN c.l_partkey IS NULL THEN 'removed' WHEN b.qty <> c.qty OR b.price <> c.price OR b.n <> c.n THEN 'modified' ELSE 'unchanged' END AS status FROM b FULL OUTER JOIN c ON b.l_partkey = c.l_partkey AND b.l_linenumber = c.l_linenumber""")
def run_diff(spark, sf_dir):
    b, c = spark_sql(spark, sf_dir, _BASE), spark_sql(spark, sf_dir, _COMP)
    return diff.full_diff(b, c, ["l_partkey", "l_linenumber"], {"qty": 0, "price": 0, "n": 0}).drop("changed")


@query(f"""WITH b AS ({duck(_BASE)}), c AS ({duck(_COMP)}), j AS (SELECT l_partkey, l_linenumber, b.qty AS bq, c.qty AS cq FROM b JOIN c USING (l_partkey, l_linenumber))
    SELECT l_partkey, l_linenumber, round(floor((cq - bq) * 100 + 0.5) / 100, 4) AS delta, round(floor(CASE WHEN bq = 0 THEN sign(cq - bq) * 100.0 ELSE (cq - bq) / abs(bq) * 100 END * 100 + 0.5) / 100, 4) AS percent FROM j""")
def metric_deltas(spark, sf_dir):
    b, c = spark_sql(spark, sf_dir, _BASE), spark_sql(spark, sf_dir, _COMP).withColumnRenamed("qty", "cq")
    d = b.join(c, ["l_partkey", "l_linenumber"]).select("l_partkey", "l_linenumber", scalars.metric_delta(F.col("qty"), F.col("cq")).alias("d"))
    return rounded(d.select("l_partkey", "l_linenumber", "d.delta", "d.percent"))


# ---- spans: an event lasts until the user's next


def _spans(d) -> str:
    return f"""SELECT CAST(user_id AS STRING) AS graph_id, CAST(row_number() OVER w AS BIGINT) AS ord, 'e' || event_id AS id, 'e' || first_value(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS parent_id,
        event_type AS name, 'a' || (event_id % 5) AS agent_id, 'tool' AS tier, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS status, 'llm_call' AS category,
        {d["ms"]("TIMESTAMP '2020-01-01 00:00:00'", "ts")} AS start_ms, {d["ms"]("TIMESTAMP '2020-01-01 00:00:00'", "ts")} + (event_id % 977) * 60000.0 AS end_ms, CAST(event_id % 100 AS DOUBLE) AS tokens, CAST(NULL AS DOUBLE) AS cost_usd
        FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


_SP, _SD = _spans(spark_functions()).replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace(", ts)", ", CAST(ts AS TIMESTAMP_NTZ))").replace("60000.0", "60000D"), f"WITH spans AS ({duck(_spans(duck_functions())).replace('60000.0', '60000.0::DOUBLE')})"


@query(f"""{_SD}, p AS (SELECT graph_id, start_ms AS t, 1 AS d FROM spans UNION ALL SELECT graph_id, end_ms, -1 FROM spans), r AS (SELECT graph_id, sum(d) OVER (PARTITION BY graph_id ORDER BY t, d) AS o FROM p) SELECT graph_id, greatest(1, max(o))::BIGINT AS peak FROM r GROUP BY 1""")
def span_peak(spark, sf_dir):
    return spans.peak_concurrency(spark_sql(spark, sf_dir, _SP))


@query(f"""{_SD}, r AS (SELECT *, max(end_ms) OVER (PARTITION BY graph_id ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id ORDER BY start_ms, end_ms, id) AS island FROM r), s AS (SELECT graph_id, island, max(end_ms) - min(start_ms) AS ms FROM i GROUP BY 1, 2)
    SELECT graph_id, round(sum(ms), 4) AS active_ms, count(*) AS islands FROM s GROUP BY 1""")
def span_active_time(spark, sf_dir):
    return rounded(spans.active_time(spark_sql(spark, sf_dir, _SP)))


@query(f"""{_SD} SELECT graph_id, count(*) AS spans, max(end_ms) - min(start_ms) AS extent_ms, sum(end_ms - start_ms) AS total_ms, round(quantile_cont(end_ms - start_ms, 0.5), 2) AS p50, round(quantile_cont(end_ms - start_ms, 0.95), 2) AS p95, round(quantile_cont(end_ms - start_ms, 0.99), 2) AS p99, count(*) FILTER (status = 'error') AS errors, sum(tokens) AS tokens, sum(cost_usd) AS cost FROM spans GROUP BY 1""")
def span_metrics(spark, sf_dir):
    return rounded(spans.metrics(spark_sql(spark, sf_dir, _SP)), 2)


@query(f"""{_SD}, k AS (SELECT graph_id, parent_id AS id, sum(end_ms - start_ms) AS below, count(*) AS children FROM spans WHERE parent_id <> id GROUP BY 1, 2)
    SELECT s.graph_id, s.id, parent_id = s.id AS is_root, (CASE WHEN parent_id = s.id THEN 0 ELSE 1 END)::INTEGER AS depth, coalesce(children, 0) AS children, greatest(0.0, end_ms - start_ms - coalesce(below, 0)) AS self_ms FROM spans s LEFT JOIN k ON k.graph_id = s.graph_id AND k.id = s.id""")
def span_tree(spark, sf_dir):
    out = spans.tree(spark_sql(spark, sf_dir, _SP))
    return out.select("graph_id", "id", F.col("parent_id").isNull().alias("is_root"), "depth", "children", "self_ms")


@query(f"""{_SD} SELECT s.graph_id, m.member, count(x.id) AS spans FROM (SELECT DISTINCT graph_id FROM spans) s CROSS JOIN (VALUES ('success'), ('error'), ('running'), ('cancelled'), ('pending')) m(member) LEFT JOIN spans x ON x.graph_id = s.graph_id AND x.status = m.member GROUP BY 1, 2""")
def span_counts(spark, sf_dir):
    return spans.counts(spark_sql(spark, sf_dir, _SP), "status")


@query(f"""{_SD} SELECT graph_id, agent_id, count(*) AS spans, sum(end_ms - start_ms) AS total_ms, max(end_ms - start_ms) AS longest_ms, sum(tokens) AS tokens, count(*) FILTER (status = 'error') AS errors FROM spans GROUP BY 1, 2""")
def span_agents(spark, sf_dir):
    return spans.by_agent(spark_sql(spark, sf_dir, _SP))


# ---- replay: events as verbs on tasks

_VERB = "CASE event_type WHEN 'signup' THEN 'task-added' WHEN 'click' THEN 'task-claimed' WHEN 'view' THEN 'task-submitted' WHEN 'error' THEN 'task-rejected' ELSE 'task-finished' END"
_LOG = f"""SELECT CAST(user_id % 10 AS STRING) AS log_id, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS BIGINT) AS event_index, count(*) OVER (PARTITION BY user_id % 10) AS n, {_VERB} AS kind, 'agent' AS actor,
    '{{{{"task_id": "u' || user_id || '"}}}}' AS payload, CAST(NULL AS STRING) AS projection FROM {{events}}""".replace("{{{{", "{{").replace("}}}}", "}}")
_LOG_SPARK, _LOG_DUCK = _LOG, duck(_LOG).replace("{{", "{").replace("}}", "}")


@query(f"""WITH log AS ({_LOG_DUCK}), e AS (SELECT *, json_extract_string(payload, '$.task_id') AS id, kind IN ('task-added', 'task-claimed') AS founds FROM log WHERE event_index <= n // 2),
    b AS (SELECT *, bool_or(founds) OVER (PARTITION BY log_id, id ORDER BY event_index) AS begun FROM e)
    SELECT log_id, id, arg_max(CASE kind WHEN 'task-added' THEN 'pending' WHEN 'task-claimed' THEN 'running' WHEN 'task-submitted' THEN 'running' WHEN 'task-rejected' THEN 'error' ELSE 'success' END, event_index) AS status FROM b WHERE begun GROUP BY 1, 2""")
def replay_status(spark, sf_dir):
    return replay.status_at(spark_sql(spark, sf_dir, _LOG_SPARK), F.expr("n div 2"))


@query(f"""WITH log AS ({_LOG_DUCK}), e AS (SELECT *, json_extract_string(payload, '$.task_id') AS id, kind IN ('task-added', 'task-claimed') AS founds FROM log WHERE event_index <= n // 2),
    b AS (SELECT *, bool_or(founds) OVER (PARTITION BY log_id, id ORDER BY event_index) AS begun FROM e)
    SELECT log_id, id, arg_max(CASE kind WHEN 'task-added' THEN 'pending' WHEN 'task-claimed' THEN 'running' WHEN 'task-submitted' THEN 'running' WHEN 'task-rejected' THEN 'error' ELSE 'success' END, event_index) AS status FROM b WHERE begun GROUP BY 1, 2""")
def replay_fold(spark, sf_dir):
    return replay.state_at(spark_sql(spark, sf_dir, _LOG_SPARK), F.expr("n div 2")).select("log_id", "id", "status")


_STATE = """(SELECT log_id, id, arg_max(CASE kind WHEN 'task-added' THEN 'pending' WHEN 'task-claimed' THEN 'running' WHEN 'task-submitted' THEN 'running' WHEN 'task-rejected' THEN 'error' ELSE 'success' END, event_index) AS status
    FROM (SELECT *, bool_or(kind IN ('task-added', 'task-claimed')) OVER (PARTITION BY log_id, id ORDER BY event_index) AS begun FROM (SELECT *, json_extract_string(payload, '$.task_id') AS id FROM log WHERE event_index <= {0})) WHERE begun GROUP BY 1, 2)"""


@query(f"""WITH log AS ({_LOG_DUCK}), a AS {_STATE.format('n // 4')}, b AS {_STATE.format('n // 2')} SELECT coalesce(a.log_id, b.log_id) AS log_id, coalesce(a.id, b.id) AS id, a.status AS status_before, b.status AS status_after FROM a FULL JOIN b ON a.log_id = b.log_id AND a.id = b.id""")
def replay_state_diff(spark, sf_dir):
    return replay.state_diff(spark_sql(spark, sf_dir, _LOG_SPARK), F.floor(F.col("n") / 4), F.expr("n div 2")).select("log_id", "id", "status_before", "status_after")


@query(f"""WITH log AS ({_LOG_DUCK}) SELECT log_id, event_index, kind, CASE WHEN kind = 'task-rejected' THEN 'failure' ELSE 'milestone' END AS bookmark FROM log WHERE kind IN ('task-rejected', 'task-finished')""")
def replay_bookmarks(spark, sf_dir):
    return replay.bookmarks(spark_sql(spark, sf_dir, _LOG_SPARK))


@query("""WITH e AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') SELECT p.user_id, p.ts, e.value AS as_of FROM events p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts""")
def as_of_join(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return replay.as_of(e.filter("event_type = 'purchase'"), e, "user_id", "ts", "value")


# ---- telemetry as bounded tables; the same functions serve streams

_PACKETS = """SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE 'p' || event_id END AS id, CASE event_type WHEN 'purchase' THEN 'metric' WHEN 'error' THEN 'log' ELSE 'node_status' END AS type, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id % 400 AS BIGINT) AS sequence, 'web' AS source,
    'node-' || (user_id % 20) AS node_id, 'agent-' || (user_id % 7) AS agent_id, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'critical' END AS priority, 'run' AS topic,
    CASE WHEN event_type IN ('click', 'view') THEN '{{"status": "' || event_type || '", "tokens": 5}}' ELSE '{{"tokens": 2}}' END AS payload, event_id AS arrival FROM {events}"""
_PACKETS_DUCK = f"WITH packets AS ({duck(_PACKETS).replace('{{', '{').replace('}}', '}')})"


def packets(spark, sf_dir):
    return spark_sql(spark, sf_dir, _PACKETS)


@query(f"""{_PACKETS_DUCK} SELECT node_id, arg_max(json_extract_string(payload, '$.status'), arrival) AS status, max(arrival) AS arrival FROM packets WHERE type = 'node_status' AND json_extract_string(payload, '$.status') IS NOT NULL GROUP BY 1""")
def packet_node_status(spark, sf_dir):
    return telemetry.node_status(packets(spark, sf_dir))


@query(f"""{_PACKETS_DUCK} SELECT agent_id, sum(CAST(json_extract_string(payload, '$.tokens') AS DOUBLE)) AS tokens, count(*) AS packets FROM packets GROUP BY 1""")
def packet_agent_usage(spark, sf_dir):
    return telemetry.agent_usage(packets(spark, sf_dir)).drop("model")


@query(f"""{_PACKETS_DUCK}, r AS (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END DESC, arrival) AS nth FROM packets) SELECT id, node_id, arrival FROM r WHERE nth <= 1000""")
def packet_shedding(spark, sf_dir):
    return telemetry.shed(packets(spark, sf_dir), 1000).select("id", "node_id", "arrival")


@query(f"""{_PACKETS_DUCK} SELECT count(DISTINCT CASE WHEN id <> '' THEN id ELSE type || '|seq:' || sequence || '|' || source || '|' || node_id || '|' || agent_id END) AS packet_keys FROM packets""")
def packet_keys(spark, sf_dir):
    return packets(spark, sf_dir).agg(F.countDistinct(telemetry.key()).alias("packet_keys"))


@query(f"""{_PACKETS_DUCK.replace("WITH packets", "WITH RECURSIVE packets", 1)}, k AS (SELECT CASE WHEN id <> '' THEN id ELSE type || '|seq:' || sequence || '|' || source || '|' || node_id || '|' || agent_id END AS key, arrival, epoch_ms(ts::TIMESTAMP) AS ms FROM packets),
    r(key, arrival) AS (SELECT key, min(arrival) FROM k GROUP BY 1 UNION SELECT r.key, min(n.arrival) FROM r JOIN k p ON p.key = r.key AND p.arrival = r.arrival JOIN k n ON n.key = r.key AND n.arrival > r.arrival AND n.ms - p.ms >= 864000000 GROUP BY r.key, r.arrival) SELECT arrival FROM r""")
def packet_first_sights(spark, sf_dir):
    return telemetry.first_sights(packets(spark, sf_dir), 864_000_000).select("arrival")


@query(f"""{_PACKETS_DUCK} SELECT time_bucket(INTERVAL '1 day', ts::TIMESTAMP) AS start, count(*) AS packets FROM packets GROUP BY 1""")
def packet_throughput(spark, sf_dir):
    return telemetry.throughput(packets(spark, sf_dir), "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""{_PACKETS_DUCK}, g AS (SELECT agent_id, ts::TIMESTAMP AS t, lag(ts::TIMESTAMP) OVER (PARTITION BY agent_id ORDER BY ts) AS before FROM packets), n AS (SELECT *, sum(CASE WHEN before IS NULL OR t >= before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY t) AS nth FROM g)
    SELECT agent_id, min(t) AS start, count(*) AS packets FROM n GROUP BY agent_id, nth""")
def packet_sessions(spark, sf_dir):
    return telemetry.sessions(packets(spark, sf_dir), "2 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""{_PACKETS_DUCK} SELECT CASE WHEN id = '' THEN arrival::VARCHAR ELSE id END AS id, type, epoch_ms(ts::TIMESTAMP) AS ms, sequence, source, node_id, agent_id, priority, topic,
    json_extract_string(payload, '$.status') AS status, json_extract_string(payload, '$.tokens')::BIGINT AS tokens, arrival FROM packets""")
def feed_packets(spark, sf_dir):
    """All packets recorded as an event stream, and read back from it."""
    path = scratch_path(spark, "feed")
    feeds.write_feed(packets(spark, sf_dir), path)
    p = feeds.packets(feeds.read_feed(spark, path))
    own = lambda c: F.get_json_object("payload", f"$.{c}")
    return p.select("id", "type", F.unix_millis("ts").alias("ms"), "sequence", "source", "node_id", "agent_id", "priority", "topic", own("status").alias("status"), own("tokens").cast("long").alias("tokens"), "arrival")


# ---- healing and collaboration

_CALLS = "SELECT CAST(user_id % 50 AS STRING) AS key, event_id AS ord, CAST(event_id AS DOUBLE) * 500 AS ts, event_type <> 'error' AS ok FROM {events}"


@query()
def circuit_breakers(spark, sf_dir):
    return healing.circuit_breakers(spark_sql(spark, sf_dir, _CALLS))


_BEATS = "SELECT user_id, event_type, CAST(floor(event_id * {gap} / users) AS BIGINT) AS ts, CAST(floor(latest * {gap} / users) AS BIGINT) AS now FROM {{events}}, (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS users, max(event_id) AS latest FROM {{events}}) u"


def _beats(gap: int) -> str:
    """Events as heartbeats that are ``gap`` ms apart for a user on average, at any size, and the time of the last one of all."""
    return _BEATS.format(gap=f"{gap}.0")


@query(f"""WITH b AS ({duck(_beats(3000))}), l AS (SELECT user_id AS node_id, max(ts) AS last, count(*) AS beats, max(now) AS now FROM b GROUP BY 1)
    SELECT node_id, last, beats, now - last AS age_ms, CASE WHEN now - last >= 5000 THEN 'dead' WHEN now - last >= 2500 THEN 'degraded' ELSE 'healthy' END AS health FROM l""")
def node_health(spark, sf_dir):
    b = spark_sql(spark, sf_dir, _beats(3000)).withColumnRenamed("user_id", "node_id")
    return healing.node_health(b.select("node_id", "ts"), F.lit(b.agg(F.max("now")).first()[0]))


_LOCKS = "SELECT 'r' || (event_id % 100) AS resource, 'a' || user_id AS agent_id, CASE user_id % 4 WHEN 0 THEN 'orchestrator' WHEN 1 THEN 'critic' WHEN 2 THEN 'implementer' ELSE 'guest' END AS role, event_id AS at FROM {events}"


@query(f"""WITH r AS ({duck(_LOCKS).replace(' AS at ', ' AS "at" ')}), n AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY CASE role WHEN 'orchestrator' THEN 5 WHEN 'critic' THEN 3 WHEN 'implementer' THEN 2 ELSE 0 END DESC, "at", agent_id) AS nth FROM r) SELECT resource, agent_id, role, "at", nth = 1 AS granted FROM n""")
def lock_arbitration(spark, sf_dir):
    return collab.arbitrate(spark_sql(spark, sf_dir, _LOCKS))


@query(f"""WITH b AS ({duck(_beats(30000))}), a AS (SELECT user_id AS agent_id, max(ts) AS last_seen, arg_max(event_type, ts) = 'error' AS is_busy, max(now) AS now FROM b GROUP BY 1), g AS (SELECT agent_id, last_seen, is_busy, now - last_seen AS age_ms FROM a)
    SELECT *, CASE WHEN age_ms >= 60000 THEN 'removed' WHEN age_ms >= 30000 THEN 'disconnected' WHEN age_ms >= 15000 AND NOT is_busy THEN 'idle' ELSE 'online' END AS presence FROM g""")
def presence_expiry(spark, sf_dir):
    b = spark_sql(spark, sf_dir, _beats(30000))
    a = b.groupBy(F.col("user_id").alias("agent_id")).agg(F.max("ts").alias("last_seen"), (F.max_by("event_type", "ts") == "error").alias("is_busy"))
    return collab.presence(a, F.lit(b.agg(F.max("now")).first()[0]))


# ---- text

_NAMES = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_name AS line FROM {part}"


def _names(spark, sf_dir):
    """The parts' names as numbered lines, counted by ranges of the key."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("line"))
    return numbered(p, [F.col("p_partkey")], "ord").select("ord", "line")


@query(f"WITH l AS ({duck(_NAMES)}) SELECT ord, line FROM l WHERE regexp_matches(lower(line), 'an')")
def text_grep(spark, sf_dir):
    return textops.grep(_names(spark, sf_dir), "an", i=True)


@query(f"WITH l AS ({duck(_NAMES)}) SELECT 0::BIGINT AS ord, count(*) || ' ' || sum(len(string_split(line, ' '))) || ' ' || sum(strlen(line) + 1) AS line FROM l")
def text_wc(spark, sf_dir):
    return textops.wc(_names(spark, sf_dir))


@query(f"WITH l AS ({duck(_NAMES)}), s AS (SELECT line, row_number() OVER (ORDER BY line, ord) - 1 AS o FROM (SELECT string_split(line, ' ')[1] AS line, ord FROM l)) SELECT line, count(*) AS n FROM s GROUP BY 1")
def text_sort_uniq(spark, sf_dir):
    lines = _names(spark, sf_dir).withColumn("line", F.split("line", " ")[0])
    out = textops.uniq(textops.sort(lines), c=True)
    return out.select(F.regexp_extract("line", r"^\s*\d+ (.*)$", 1).alias("line"), F.trim(F.regexp_extract("line", r"^\s*(\d+) ", 1)).cast("long").alias("n"))


_LIKE = "SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'e', '') WHEN 2 THEN left(p_name, CAST(p_size % 9 AS INTEGER)) ELSE concat(p_type, ' ', p_name) END AS b FROM {part}"


@query(f"""WITH x AS ({duck(_LIKE)}) SELECT p_partkey, levenshtein(a, b) AS distance, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 6) AS similarity FROM x""")
def text_similarity(spark, sf_dir):
    """Names against the same, without a letter, cut short, or with words before them."""
    p = spark_sql(spark, sf_dir, _LIKE)
    return rounded(p.select("p_partkey", F.levenshtein("a", "b").cast("long").alias("distance"), scalars.similarity(F.col("a"), F.col("b")).alias("similarity")), 6)


_LETTERS = """a AS (SELECT *, trim(name) AS t, lower(trim(name)) AS low, length(trim(name)) AS n FROM items),
    b AS (SELECT *, instr(low, 's') - 1 AS p0 FROM a), c AS (SELECT *, CASE WHEN p0 >= 0 AND instr(substr(low, p0 + 2), 't') > 0 THEN p0 + instr(substr(low, p0 + 2), 't') END AS p1 FROM b),
    d AS (SELECT *, CASE WHEN p1 IS NOT NULL AND instr(substr(low, p1 + 2), 'e') > 0 THEN p1 + instr(substr(low, p1 + 2), 'e') END AS p2 FROM c),
    w AS (SELECT *, list_filter(list_transform(string_split_regex(low, '[\\s\\-_/.]+'), lambda x, i: CASE WHEN starts_with(x, 'ste') THEN 650 - 20 * (i - 1) - least(100, 2 * (length(x) - 3)) END), lambda x: x IS NOT NULL)[1] AS word,
          array_to_string(list_transform(string_split_regex(low, '[\\s\\-_/.]+'), lambda x: left(x, 1)), '') AS initials, [p0, p1, p2] AS ps FROM d),
    k AS (SELECT *, len(list_filter(ps, lambda p: p = 0 OR regexp_matches(substr(low, p, 1), '[\\s\\-_/.]'))) AS starts, p1 - p0 - 1 AS g1, p2 - p1 - 1 AS g2 FROM w),
    s AS (SELECT *, CASE WHEN low = 'ste' THEN 1000 + greatest(0, 100 - n) WHEN starts_with(low, 'ste') THEN 800 - least(200, 2 * (n - 3)) WHEN word IS NOT NULL THEN word
          WHEN regexp_matches(initials, 's.*t.*e') THEN 550 + greatest(0, 50 - (n - 3)) WHEN p2 IS NULL THEN 0
          ELSE greatest(10, 100 + 35 * starts - least(40, 3 * p0) + (CASE WHEN g1 = 0 THEN 20 ELSE -least(30, 2 * g1) END) + (CASE WHEN g2 = 0 AND g1 = 0 THEN 40 WHEN g2 = 0 THEN 20 ELSE -least(30, 2 * g2) END) + greatest(0, 100 - n)) END::DOUBLE AS score FROM k)"""


@query(f"WITH items AS (SELECT p_partkey AS key, p_name || ' ' || p_type AS name FROM part), {_LETTERS} SELECT key, score FROM s WHERE score > 0")
def text_fuzzy(spark, sf_dir):
    p = spark_sql(spark, sf_dir, "SELECT p_partkey AS key, p_name || ' ' || p_type AS name FROM {part}")
    return p.select("key", scalars.fuzzy_score("ste", F.col("name")).alias("score")).filter("score > 0")


@query(f"""WITH items AS (SELECT p_partkey AS key, 1.0::DOUBLE AS weight, p_name AS name FROM part UNION ALL SELECT p_partkey, 0.7, p_brand FROM part UNION ALL SELECT p_partkey, 0.85, unnest([p_type, p_name || '-' || p_type]) FROM part), {_LETTERS}
    SELECT key, max(CASE WHEN weight = 1 THEN score ELSE floor(score * weight) END) AS score FROM s GROUP BY 1 HAVING max(CASE WHEN weight = 1 THEN score ELSE floor(score * weight) END) > 0""")
def text_palette(spark, sf_dir):
    """Palette entries by title, description and keywords."""
    p = spark_sql(spark, sf_dir, "SELECT p_partkey AS key, p_name AS title, p_brand AS description, array(p_type, p_name || '-' || p_type) AS keywords FROM {part}")
    return scalars.fuzzy_search(p, "ste").select("key", "score")


@query()
def text_lcs(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", scalars.lcs_similarity(F.col("p_name"), F.col("p_type")).alias("lcs"))


def _error_case(column: str) -> str:
    """The ordered rules as one CASE; the words are those of the fixed table."""
    def hit(name, words):
        some = [f"contains(lower({column}), '{w}')" for w in words]
        return " OR ".join(some + [f"regexp_matches(lower({column}), '{scalars.SYNTAX_PATTERN}')"] * (name == "syntax_type"))

    return "CASE " + " ".join(f"WHEN {hit(n, w)} THEN '{n}'" for n, w in scalars.ERROR_WORDS.items()) + " ELSE 'runtime_unhandled' END"


def _complaints() -> str:
    """Turns with words of all classes in turn, or none."""
    words = [w for some in scalars.ERROR_WORDS.values() for w in some]
    cases = " ".join(f"WHEN {k} THEN ' {w.upper() if k % 2 else w} '" for k, w in enumerate([*words, "TS2304", "retype", "fine"]))
    return f"SELECT conv_id, turn, concat(coalesce(text, ''), CASE (conv_id * 7 + turn) % {len(words) + 3} {cases} END) AS message FROM {{conversations}}"


@query(f"WITH m AS ({duck(_complaints())}) SELECT conv_id, turn, {_error_case('message')} AS error_class FROM m")
def text_error_class(spark, sf_dir):
    m = spark_sql(spark, sf_dir, _complaints())
    return m.select("conv_id", "turn", scalars.error_class(F.col("message")).alias("error_class"))
