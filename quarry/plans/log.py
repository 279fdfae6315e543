"""Registered queries over logs: events stand for queries, logins and requests; customers and orders for users and what they own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import labels
from quarry.operators import quotas, ranking, usage
from quarry.sources.readers import table
from quarry.streaming import gates

NOW = "2024-01-28 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def as_log(spark: SparkSession, d: str) -> DataFrame:
    """events with the columns of a query log."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    score = F.least(F.col("value") / 100, F.lit(1.0))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 97 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string"))).alias("ip"),
        "user_id", F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))).alias("username"),
        F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "ask").otherwise("ask_stream").alias("kind"), F.concat_ws(" ", "event_type", k.cast("string")).alias("query"),
        (k % 4).alias("sources_count"), score.alias("top_score"), labels.answered(k % 4, score).alias("answered"), (k % 5 == 0).alias("marked"), F.lit(1).alias("repeat_count"),
        F.when(F.col("event_type") == "signup", "solved").when(F.col("event_type") == "error", "odd").otherwise("").alias("feedback"),
    )


LOG = """WITH log AS (
    SELECT event_id AS id, ts AS created_at, CASE WHEN event_id % 97 = 0 THEN '' ELSE '10.0.0.' || (user_id % 50) END AS ip, user_id,
        CASE WHEN user_id % 10 = 0 THEN '' ELSE 'u' || (user_id % 40) END AS username,
        CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'ask' ELSE 'ask_stream' END AS kind,
        event_type || ' ' || json_extract_string(props, '$.k') AS query, json_extract_string(props, '$.k')::INT % 4 AS sources_count, least(value / 100, 1.0) AS top_score,
        json_extract_string(props, '$.k')::INT % 4 > 0 AND least(value / 100, 1.0) >= 0.45 AS answered, json_extract_string(props, '$.k')::INT % 5 = 0 AS marked, 1 AS repeat_count,
        CASE event_type WHEN 'signup' THEN 'solved' WHEN 'error' THEN 'odd' ELSE '' END AS feedback
    FROM events)"""


def bans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("s_suppkey") % 60).cast("int"))
    return s.select(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 70).cast("string")).alias("ip"), F.when(F.col("s_suppkey") % 3 > 0, day).alias("expires_at"))


BANS = "bans AS (SELECT '10.0.0.' || (s_suppkey % 70) AS ip, CASE WHEN s_suppkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_days((s_suppkey % 60)::INT) END AS expires_at FROM supplier)"


def active_keys(spark, d):
    return usage.active_ips(as_log(spark, d), now(), days=14, limit=20, bans=bans(spark, d))


def overview(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("is_active"))
    return usage.overview(as_log(spark, d), users, bans(spark, d), now())


def login_summary(spark, d):
    logins = as_log(spark, d).select("id", "user_id", "ip", "created_at", F.col("kind").alias("user_agent"))
    return usage.login_summary(logins, newest=500, limit=3)


def newest_logins(spark, d):
    return usage.newest_logins(as_log(spark, d).select("id", "user_id", "ip", "created_at"), 50)


def user_rollup(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    sessions = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return usage.user_rollup(users, sessions, as_log(spark, d).select("user_id", "created_at"))


def log_page(spark, d):
    return usage.log_page(as_log(spark, d), 2, 50, only_unanswered=True, kind="ask_stream").select("id", "ip", "query", "sources_count", F.round("top_score", 6).alias("top_score"))


def log_filtered_count(spark, d):
    return usage.log_count(as_log(spark, d), marked_only=True, ip="::FFFF:10.0.0.7")


def answered_label(spark, d):
    log = as_log(spark, d)
    return log.select("id", "answered", labels.answered_after_feedback(F.col("answered"), F.col("feedback")).alias("answered_now"), F.when(F.col("feedback") != "", labels.feedback_kind(F.col("feedback"))).otherwise("").alias("feedback"))


def retention_keep_newest(spark, d):
    return ranking.newest(as_log(spark, d).select("id", "created_at"), "id", 2000)


def request_metrics(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"), labels.url_template(F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("/x9"))).alias("path"), status.alias("status"), (F.col("value") * 100).cast("long").alias("ms"))
    return usage.request_metrics(rows)


def request_severity(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    return e.groupBy(labels.severity(status, (F.col("value") * 100).cast("long")).alias("severity")).agg(F.count("*").alias("n"))


def url_templates(spark, d):
    return table(spark, d, "pages").groupBy(labels.url_template(F.col("url")).alias("template")).agg(F.count("*").alias("n"))


def _attachments(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("user_id"), F.concat(F.lit("10.0.0."), (F.col("o_orderkey") % 50).cast("string")).alias("ip"), (F.col("o_totalprice") * 10).cast("long").alias("size"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


def storage_usage(spark, d):
    return usage.storage_usage(_attachments(spark, d))


def quota_gates(spark, d):
    up = as_log(spark, d).select(F.col("id").alias("upload_id"), (F.col("user_id") % 300).alias("user_id"), "ip", (F.col("sources_count") * 8 * 1024 * 1024).cast("long").alias("bytes"), (F.col("id") % 5).cast("int").alias("files"))
    return usage.quota_snapshot(up, _attachments(spark, d), F.lit("1995-06-17 12:00:00").cast("timestamp_ntz"), labels.Tunables(total_mb=100_000))


def quota_replay(spark, d):
    """All uploads in order, each judged by what was taken before it."""
    n = F.col("id")
    up = as_log(spark, d).select("id", (F.col("user_id") % 300).alias("user_id"), "ip", "created_at", ((n % 7) * 4 * 1024 * 1024 + n % 1000).alias("bytes"), (n % 5).cast("int").alias("files"))
    return quotas.quota_replay(up, t=labels.Tunables(total_mb=9_000)).select("id", "refused")


def rate_limit(spark, d):
    log = as_log(spark, d)
    return gates.rate_limit(log, ["ip"], "created_at", "id", labels.rate_cap(F.lit("heavy"), F.col("username") != "", labels.Tunables(rate_user=3, rate_anonymous=2)), window_s=6 * 3600)


def fixed_anchor_dedup(spark, d):
    return gates.fixed_anchor(as_log(spark, d), ["ip", "kind"], "created_at", "id", window_s=3600)


def alert_gate(spark, d):
    return gates.alert_gate(as_log(spark, d), "query", "created_at", "id")


def ban_list(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 70).cast("string")).alias("ip"), F.col("s_name").alias("reason"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("s_suppkey") % 7).cast("int"))).alias("created_at"), F.when(F.col("s_suppkey") % 3 > 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("s_suppkey") % 60).cast("int"))).alias("expires_at"))
    return usage.ban_list(rows, now(), 1, 30)


def user_books(spark, d):
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "{}").when(F.col("o_orderkey") % 7 == 0, "oops").otherwise(F.to_json(F.sequence(F.lit(1), F.lit(1) + (F.col("o_orderkey") % 4).cast("int")))).alias("entries"), F.col("o_orderdate").alias("updated_at"))
    return usage.user_books(lines).select("user_id", "id", "name", F.col("n_entries").cast("long").alias("n_entries"))


def user_cards(spark, d):
    cards = table(spark, d, "part").select((F.col("p_size") % 3).alias("user_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_type", " ").alias("tags"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("image_path"), F.col("p_retailprice").alias("updated_at"))
    return usage.user_cards(cards)


def consecutive_failures(spark, d):
    checks = as_log(spark, d).select("id", F.col("ip").alias("target"), F.struct("created_at", "id").alias("at"), F.col("answered").alias("ok"))
    return usage.consecutive_failures(checks).select("id", "target", F.col("failures").cast("long").alias("failures"), "restart")


def llm_usage(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("prompt_tokens"), F.col("l_quantity").cast("long").alias("completion_tokens"), F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_orderkey")).cast("long").alias("total_tokens"))
    return usage.llm_usage(calls)


def items_page(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("user_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.split("p_name", " ").alias("tags"), F.col("p_retailprice").alias("updated_at"))
    return usage.items_page(items, 1, 40, user_id=1, search="BOLT", tags=["", "blue", "red"]).select("id", "name", "description")


def ip_labels(spark, d):
    log = as_log(spark, d)
    raw = F.when((F.col("id") % 3 == 0) & (F.col("ip") != ""), F.concat(F.lit(" ::FFFF:"), "ip")).otherwise(F.col("ip"))
    hops = F.when(F.col("id") % 4 == 0, F.concat(F.lit("1.2.3.4, "), "ip", F.lit(" ")))
    return log.select("id", labels.normalize_ip(raw).alias("ip"), labels.is_loopback(raw).alias("loopback"), labels.client_ip(hops, F.lit(""), F.lit("9.9.9.9")).alias("client"))


QUERIES = {f.__name__: f for f in (active_keys, overview, login_summary, newest_logins, user_rollup, log_page, log_filtered_count, answered_label, retention_keep_newest, request_metrics, request_severity, url_templates, storage_usage, quota_gates, quota_replay, rate_limit, fixed_anchor_dedup, alert_gate, consecutive_failures, llm_usage, items_page, ip_labels, ban_list, user_books, user_cards)}

_STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END"
_ATT = "att AS (SELECT o_orderkey AS id, o_custkey % 200 AS user_id, '10.0.0.' || (o_orderkey % 50) AS ip, trunc(o_totalprice * 10)::BIGINT AS size, o_orderdate AS created_at FROM orders)"
SQL = {
    "active_keys": f"""{LOG}, {BANS}, w AS (SELECT * FROM log WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND ip <> '')
        SELECT w.ip, count(*) AS n, count(DISTINCT nullif(username, '')) AS n_users, coalesce(string_agg(DISTINCT nullif(username, ''), ',' ORDER BY nullif(username, ''))[:200], '') AS usernames, max(created_at) AS last_at,
            w.ip IN (SELECT ip FROM bans WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}') AS banned
        FROM w GROUP BY w.ip ORDER BY n DESC, w.ip LIMIT 20""",
    "overview": f"""{LOG}, {BANS} SELECT count(*) AS queries_total, count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{NOW}')) AS queries_today, count(*) FILTER (answered) AS queries_answered,
            count(*) FILTER (NOT answered) AS queries_unanswered, count(*) FILTER (marked) AS queries_marked, count(*) FILTER (feedback <> '') AS queries_rated, sum(repeat_count)::BIGINT AS queries_with_repeats,
            (SELECT count(*) FROM customer) AS users_total, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS users_banned,
            (SELECT count(*) FROM bans WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}') AS ips_banned, 0.45::DOUBLE AS threshold FROM log""",
    "login_summary": f"""{LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM log),
        p AS (SELECT user_id, coalesce(nullif(ip, ''), '(未知)') AS ip, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, array_to_string(list_sort(list(DISTINCT kind))[:2], '；') AS agents FROM n WHERE r <= 500 GROUP BY 1, 2)
        SELECT * EXCLUDE q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, ip) AS q FROM p) WHERE q <= 3""",
    "newest_logins": f"{LOG} SELECT id, user_id, ip, created_at FROM log ORDER BY id DESC LIMIT 50",
    "user_rollup": f"""{LOG} SELECT c_custkey AS user_id, c_name AS name, coalesce(s.n, 0) AS n_sessions, coalesce(q.n, 0) AS n_queries, q.last_query FROM customer
        LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) s ON s.k = c_custkey LEFT JOIN (SELECT user_id AS k, count(*) AS n, max(created_at) AS last_query FROM log GROUP BY 1) q ON q.k = c_custkey""",
    "log_page": f"{LOG} SELECT id, ip, query, sources_count, round(top_score, 6) AS top_score FROM log WHERE NOT answered AND kind = 'ask_stream' ORDER BY id DESC LIMIT 50 OFFSET 50",
    "log_filtered_count": f"{LOG} SELECT count(*) AS total FROM log WHERE marked AND ip = '10.0.0.7'",
    "answered_label": f"{LOG} SELECT id, answered, CASE feedback WHEN '' THEN answered ELSE feedback = 'solved' END AS answered_now, CASE feedback WHEN 'odd' THEN 'unsolved' ELSE feedback END AS feedback FROM log",
    "retention_keep_newest": f"{LOG} SELECT id, created_at FROM log ORDER BY id DESC LIMIT 2000",
    "request_metrics": f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/api/' || event_type || '/{{id}}/x9' AS path, {_STATUS} AS status, count(*) AS n,
        sum(trunc(value * 100)::BIGINT)::BIGINT AS total_ms, count(*) FILTER (trunc(value * 100)::BIGINT >= 3000) AS n_slow FROM events GROUP BY 1, 2, 3""",
    "request_severity": f"SELECT CASE WHEN {_STATUS} >= 500 THEN 'error' WHEN {_STATUS} >= 400 OR trunc(value * 100)::BIGINT >= 3000 THEN 'warn' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1",
    "url_templates": "SELECT regexp_replace(url, '/\\d+', '/{id}', 'g') AS template, count(*) AS n FROM pages GROUP BY 1",
    "storage_usage": f"WITH {_ATT} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS used_bytes, round(sum(size) / 1048576, 2) AS used_mb, round(100 * (sum(size) / 1048576) / 1024, 2) AS percent FROM att",
    "quota_gates": f"""{LOG}, {_ATT}, up AS (SELECT id AS upload_id, user_id % 300 AS user_id, ip, (sources_count * 8 * 1024 * 1024)::BIGINT AS bytes, (id % 5)::INT AS files FROM log),
        u AS (SELECT user_id, count(*) AS n FROM att GROUP BY 1), i AS (SELECT ip, count(*) AS n FROM att WHERE created_at >= TIMESTAMP '1995-06-17' GROUP BY 1)
        SELECT up.*, CASE WHEN (SELECT coalesce(sum(size), 0) FROM att) + bytes > 100000 * 1048576::BIGINT THEN 'total' WHEN bytes > 20 * 1048576 THEN 'file' WHEN files > 3 THEN 'submit'
            WHEN coalesce(u.n, 0) + files > 50 THEN 'user' WHEN coalesce(i.n, 0) + files > 5 THEN 'ip_day' END AS refused FROM up LEFT JOIN u ON u.user_id = up.user_id LEFT JOIN i ON i.ip = up.ip""",
    "quota_replay": f"""{LOG.replace("WITH log", "WITH RECURSIVE log")}, q AS MATERIALIZED (SELECT id, user_id % 300 AS u, ip, created_at::DATE AS day, (id % 7) * 4 * 1048576 + id % 1000 AS bytes, id % 5 AS files, row_number() OVER (ORDER BY created_at, id) AS n FROM log),
        r AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS refused, NULL::DATE AS day, 0::BIGINT AS total, MAP([-1::BIGINT], [0::BIGINT]) AS us, MAP(['none'], [0::BIGINT]) AS ips
            UNION ALL SELECT x.n, x.id, x.g, x.day, CASE WHEN g IS NULL THEN total + bytes ELSE total END, CASE WHEN g IS NULL THEN map_concat(us, MAP([x.u], [coalesce(us[x.u], 0) + files])) ELSE us END,
                CASE WHEN g IS NULL THEN map_concat(x.was, MAP([x.ip], [coalesce(x.was[x.ip], 0) + files])) ELSE x.was END
            FROM (SELECT *, CASE WHEN total + bytes > 9000 * 1048576::BIGINT THEN 'total' WHEN bytes > 20 * 1048576 THEN 'file' WHEN files > 3 THEN 'submit' WHEN coalesce(us[u], 0) + files > 50 THEN 'user' WHEN coalesce(was[ip], 0) + files > 5 THEN 'ip_day' END AS g
                FROM (SELECT q.*, r.total, r.us, CASE WHEN r.day = q.day THEN r.ips ELSE MAP(['none'], [0::BIGINT]) END AS was FROM r JOIN q ON q.n = r.n + 1)) x)
        SELECT id, refused FROM r WHERE n > 0""",
    "rate_limit": f"""{LOG.replace("WITH log", "WITH RECURSIVE log")}, h AS MATERIALIZED (SELECT ip, id, epoch_us(created_at) AS us, CASE WHEN username <> '' THEN 3 ELSE 2 END::BIGINT AS cap, row_number() OVER (PARTITION BY ip ORDER BY created_at, id) AS n FROM log),
        step AS (SELECT ip, id, us, cap, n, []::BIGINT[] AS kept FROM h WHERE n = 1
            UNION ALL SELECT h.ip, h.id, h.us, h.cap, h.n, list_filter(CASE WHEN len(s.kept) < s.cap THEN s.kept || [s.us] ELSE s.kept END, lambda t: t > h.us - 21600000000) FROM step s JOIN h ON h.ip = s.ip AND h.n = s.n + 1)
        SELECT ip, id, us, cap, len(kept) < cap AS allowed, CASE WHEN len(kept) < cap THEN 0 ELSE greatest(1, (21600000000 - (us - kept[1])) // 1000000 + 1) END::BIGINT AS retry_after FROM step""",
    "fixed_anchor_dedup": f"""{LOG.replace("WITH log", "WITH RECURSIVE log")}, h AS MATERIALIZED (SELECT ip, kind, id, epoch_us(created_at) AS us, row_number() OVER (PARTITION BY ip, kind ORDER BY created_at, id) AS n FROM log),
        step AS (SELECT ip, kind, id, us, n, id AS anchor_id, us AS since, 1::BIGINT AS repeat_no FROM h WHERE n = 1
            UNION ALL SELECT h.ip, h.kind, h.id, h.us, h.n, CASE WHEN h.us - s.since >= 3600000000 THEN h.id ELSE s.anchor_id END, CASE WHEN h.us - s.since >= 3600000000 THEN h.us ELSE s.since END,
                CASE WHEN h.us - s.since >= 3600000000 THEN 1 ELSE s.repeat_no + 1 END FROM step s JOIN h ON h.ip = s.ip AND h.kind = s.kind AND h.n = s.n + 1)
        SELECT ip, kind, id, us, anchor_id, repeat_no FROM step""",
    "alert_gate": f"""{LOG.replace("WITH log", "WITH RECURSIVE log")}, h AS MATERIALIZED (SELECT id, epoch_us(created_at) AS us, query AS key, row_number() OVER (ORDER BY created_at, id) AS n FROM log),
        step AS (SELECT id, us, key, n, []::STRUCT(t BIGINT, k VARCHAR)[] AS kept, true AS sent FROM h WHERE n = 1
            UNION ALL SELECT id, us, key, n, kept, len(list_filter(kept, lambda x: us - x.t < 600000000)) < 3 AND len(list_filter(kept, lambda x: x.k = key AND us - x.t < 300000000)) = 0
            FROM (SELECT h.id, h.us, h.key, h.n, list_filter(CASE WHEN s.sent THEN s.kept || [struct_pack(t := s.us, k := s.key)] ELSE s.kept END, lambda x: h.us - x.t < 600000000) AS kept FROM step s JOIN h ON h.n = s.n + 1))
        SELECT id, us, key, sent FROM step""",
    "ban_list": f"""SELECT s_suppkey AS id, '10.0.0.' || (s_suppkey % 70) AS ip, s_name AS reason, TIMESTAMP '2024-01-01' + to_days((s_suppkey % 7)::INT) AS created_at, CASE WHEN s_suppkey % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_days((s_suppkey % 60)::INT) END AS expires_at, true AS active
        FROM supplier WHERE s_suppkey % 3 = 0 OR TIMESTAMP '2024-01-01' + to_days((s_suppkey % 60)::INT) >= TIMESTAMP '{NOW}' ORDER BY created_at DESC, id DESC LIMIT 30""",
    "user_books": "SELECT o_custkey AS user_id, o_orderkey AS id, o_orderstatus AS name, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE 1 + o_orderkey % 4 END AS n_entries FROM orders",
    "user_cards": "SELECT p_size % 3 AS user_id, p_partkey AS id, p_name AS name, array_to_string(string_split(p_type, ' ')[:6], '、') AS tags, p_partkey % 2 = 0 AS has_image, p_retailprice AS updated_at FROM part",
    "consecutive_failures": f"""{LOG}, a AS (SELECT *, sum(answered::INT) OVER (PARTITION BY ip ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS g FROM log),
        b AS (SELECT *, sum((NOT answered)::INT) OVER (PARTITION BY ip, g ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM a)
        SELECT id, ip AS target, CASE WHEN n > 0 THEN (n - 1) % 2 + 1 ELSE 0 END::BIGINT AS failures, n > 0 AND n % 2 = 0 AS restart FROM b""",
    "llm_usage": """SELECT count(*) AS calls, sum(l_linenumber)::BIGINT AS prompt, sum(trunc(l_quantity)::BIGINT)::BIGINT AS completion,
        sum(CASE WHEN l_returnflag = 'N' OR l_orderkey = 0 THEN l_linenumber + trunc(l_quantity)::BIGINT ELSE l_orderkey END)::BIGINT AS total FROM lineitem""",
    "items_page": """SELECT p_partkey AS id, p_name AS name, p_brand AS description FROM part WHERE p_size % 3 = 1 AND (lower(p_name) LIKE '%bolt%' OR lower(p_brand) LIKE '%bolt%')
        AND list_has_any(string_split(p_name, ' '), ['blue', 'red']) ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 40""",
    "ip_labels": f"{LOG} SELECT id, ip, ip = '' AS loopback, CASE WHEN id % 4 = 0 THEN coalesce(nullif(ip, ''), '1.2.3.4') ELSE '9.9.9.9' END AS client FROM log",
}
