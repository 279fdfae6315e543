"""Registered queries over changes of stored tables and small rules: part stands for cards, customer for users, orders for sessions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import labels, text
from quarry.operators import doctree, ingest, mutations, usage
from quarry.plans.log import LOG, NOW, as_log, now
from quarry.sources.readers import table
from quarry.streaming import gates


def _cards(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("user_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("description"))


_CARDS = "WITH cards AS (SELECT p_partkey AS id, p_size % 3 AS user_id, p_name AS name, p_brand AS description FROM part)"


def _files(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("user_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("ref_id"), F.when(F.col("o_orderkey") % 3 > 0, "query").otherwise("feedback").alias("source"), F.concat("o_orderpriority", F.lit(".PDF")).alias("orig_name"))


_FILES = "files AS (SELECT o_orderkey AS id, o_custkey % 50 AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS ref_id, CASE WHEN o_orderkey % 3 > 0 THEN 'query' ELSE 'feedback' END AS source, o_orderpriority || '.PDF' AS orig_name FROM orders)"
_IDS = [3, 5, 8, 13, 21, 34, 55, 89, 144, 10**9]


def delete_own(spark, d):
    return mutations.delete(_cards(spark, d), _IDS, owner=1, admin=False)


def partial_update(spark, d):
    cards = _cards(spark, d)
    patch = cards.where("id % 10 = 0").select("id", F.upper("name").alias("name"), F.lit(None).cast("string").alias("description"), F.when(F.col("id") % 20 == 0, F.array(F.lit("name"), F.lit("description"))).otherwise(F.array(F.lit("name"))).alias("given"), F.lit(2).alias("seq"))
    return mutations.update(cards, patch.union(patch.withColumn("name", F.lit("older")).withColumn("seq", F.lit(1))), at="seq")


def mark_rows(spark, d):
    log = as_log(spark, d).select("id", "marked", F.lit(None).cast("timestamp_ntz").alias("marked_at"))
    return mutations.mark(log, _IDS, True, now())


def rate_rows(spark, d):
    log = as_log(spark, d).select("id", "answered", "feedback", F.lit("").alias("feedback_reason"), F.lit(None).cast("timestamp_ntz").alias("feedback_at"))
    ratings = as_log(spark, d).where("kind = 'ask'").select("id", F.when(F.col("id") % 2 == 0, "solved").otherwise("what").alias("kind"), F.repeat("query", F.lit(60)).alias("reason"), F.lit(2).alias("seq"))
    older = ratings.withColumn("kind", F.lit("irrelevant")).withColumn("seq", F.lit(1))
    return mutations.rate(log, ratings.union(older), now(), at="seq")


def append_logins(spark, d):
    log = as_log(spark, d).select("id", F.col("query").alias("user_agent"), F.col("kind").alias("action"))
    more = as_log(spark, d).where("id % 5 = 0").select((F.col("id") + 10**6).alias("id"), F.repeat("query", F.lit(50)).alias("user_agent"), F.repeat("kind", F.lit(5)).alias("action"))
    return mutations.append(log, more, {"user_agent": 255, "action": 16})


def clear_unanswered(spark, d):
    log = as_log(spark, d).select("id", F.when(F.col("id") % 11 > 0, F.col("answered")).alias("answered"))
    return mutations.clear_log(log, True)


def handle_feedback(spark, d):
    rows = _cards(spark, d).select("id", (F.col("id") % 2 == 0).alias("handled"), F.lit(None).cast("timestamp_ntz").alias("handled_at"), F.lit("").alias("handled_by"))
    return mutations.handle(rows, 21, True, "boss", now())


def ban_upsert(spark, d):
    bans = table(spark, d, "supplier").where("s_suppkey <= 30").select(F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("ip"), F.col("s_name").alias("reason"), now().alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    new = table(spark, d, "supplier").where("s_suppkey > 20").select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "::ffff:").otherwise(""), F.lit("10.0.0."), (F.col("s_suppkey") % 50).cast("string")).alias("ip"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("again "), F.col("s_suppkey").cast("string"))).alias("reason"), now().alias("expires_at"), "s_suppkey")
    new = new.union(spark.range(1).select(F.lit("127.0.0.1"), F.lit("no"), now(), F.lit(0).cast("long")))
    return mutations.ban_ips(bans, new, now(), at="s_suppkey")


def _users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("is_active"), F.lit("").alias("ban_reason"), F.lit(None).cast("timestamp_ntz").alias("banned_at"), F.lit(None).cast("boolean").alias("is_admin"))


def ban_user(spark, d):
    sessions = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    users, left, kicked = mutations.ban_user(_users(spark, d), sessions, 7, "spam" * 100, now())
    return users.crossJoin(F.broadcast(left.agg(F.count("*").alias("n_left")))).crossJoin(F.broadcast(kicked))


def first_admin(spark, d):
    return mutations.first_user_is_admin(mutations.unban_user(_users(spark, d), 3)).select("id", "is_active", "is_admin")


def live_sessions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("expires_at"))
    return mutations.drop_expired(o, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))


def append_feedback(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("content"), F.when(F.col("doc_id") % 2 == 0, "故障").otherwise("else").alias("category"))
    return mutations.feedback_rows(e, now()).select("id", F.length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("md5"), "category", "handled")


def bind_files(spark, d):
    ids = [r * 7 + 1 for r in range(30)]
    return mutations.bind_attachments(_files(spark, d).select("id", "user_id", "ref_id", "source"), ids, 3, "answer", 77)


def log_files(spark, d):
    got = usage.log_with_attachments(as_log(spark, d).select("id", "feedback"), _files(spark, d))
    return got.select("id", F.size("files").alias("n_files"), F.array_join(F.transform("files", lambda x: x["orig_name"]), ",").alias("names"))


def client_errors(spark, d):
    e = as_log(spark, d).select("id", F.col("ip").alias("session"), "kind", F.repeat("query", F.lit(300)).alias("message"), F.col("username").alias("page"), "created_at")
    return usage.client_errors(e, most=5).select("id", "session", "kind", F.length("message").alias("n_chars"))


def rate_tiers(spark, d):
    p = F.concat(F.element_at(F.array(*map(F.lit, ("/api/auth/login", "/api/rag/ask", "/api/items", "/api/tools/x", "/api/auth/me"))), (F.col("id") % 5 + 1).cast("int")))
    bucket = labels.rate_bucket(p)
    return as_log(spark, d).select("id", bucket.alias("bucket"), labels.rate_cap(bucket, F.col("username") != "").cast("long").alias("cap"))


def visibility(spark, d):
    log = as_log(spark, d)
    return log.select("id", labels.owner_or_admin(F.col("user_id"), F.col("id") % 20, F.col("id") % 9 == 0).alias("visible"), labels.may_rate(F.col("user_id"), F.col("ip"), F.col("id") % 20, F.concat(F.lit("10.0.0."), (F.col("id") % 50).cast("string"))).alias("may_rate"))


def names_and_keys(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.safe_name(F.col("text")).alias("safe"), text.masked_key(F.substring("text", 1, 12)).alias("masked"), text.masked_key(F.substring("text", 1, 5)).alias("short"), F.md5(text.embedding_input(F.when(F.col("doc_id") % 7 == 0, " \t").otherwise(F.col("text"))).cast("binary")).alias("given"), labels.file_type(F.concat(F.substring("text", 1, 3), F.lit(".Md"))).alias("kind"))


def qa_answers(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 300).alias("request_id"), F.col("event_id").alias("ordinal"), F.element_at(F.array(*map(F.lit, ("token", "sources", "token", "done", "error"))), (F.col("event_id") % 5 + 1).cast("int")).alias("type"), F.get_json_object("props", "$.k").alias("data"))
    return usage.answers(e)


def merged_log(spark, d):
    log = as_log(spark, d).withColumn("answer", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("a"), F.col("id").cast("string")))).select("id", "ip", "kind", "created_at", "sources_count", "top_score", "answered", "answer", "repeat_count")
    anchors = gates.fixed_anchor(log, ["ip", "kind"], "created_at", "id", window_s=3600)
    return gates.merged_log(log, anchors).select("id", "sources_count", F.round("top_score", 6).alias("top_score"), "answered", "answer", "repeat_count")


def consistency(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    return doctree.consistency(docs.where("doc_id % 3 > 0").select("path"), docs.where("doc_id % 4 > 0").select("path"))


def _raw_pages(spark, d):
    i = F.col("doc_id")
    head = F.concat(
        F.lit("---\ntitle: "), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit('"T'), i.cast("string"), F.lit('"'))), F.lit("\nroute: "), F.when(i % 9 == 0, "").when(i % 14 == 0, "/verify/x").otherwise(F.concat(F.lit("/a/p"), i.cast("string"), F.lit("/"))),
        F.lit("\norder: "), F.when(i % 2 == 0, i.cast("string")).otherwise("x"), F.lit("\nvisibility: "), F.when(i % 10 == 0, "Hidden").otherwise(""), F.lit("\n---\n# H"), i.cast("string"), F.lit("\n"),
    )
    return table(spark, d, "documents").select("doc_id", F.when(i % 25 == 0, F.lit("# Index Probe")).otherwise(F.concat(head, F.coalesce("text", F.lit("")))).alias("text"))


def page_rules(spark, d):
    raw = _raw_pages(spark, d)
    sources = raw.where("doc_id % 13 > 0").select(text.content_hash(F.col("text")).alias("key"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_rel"))
    return doctree.pages(raw.select("text"), sources).select("key", "route", "title", "ord", "source_rel", "skip_reason")


def skip_tallies(spark, d):
    return page_rules(spark, d).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def article_lookup(spark, d):
    route = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    nodes = doctree.tree(table(spark, d, "pages").select(route.alias("route"), F.lit("t").alias("title")))
    asked = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("no"), route)).otherwise(F.trim(route, F.lit("/"))).alias("route")).distinct()
    return doctree.article(nodes, asked).select("asked", "title", "top_level", doctree.route_path(F.col("asked")).alias("path"))


def running_numbers(spark, d):
    return ingest.numbered(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"])


def translated(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 6 = 0").select(text.content_hash(F.col("text")).alias("key"), F.concat(F.lit("cached "), F.substring("text", 1, 20)).alias("translated")).dropDuplicates(["key"])
    out, _ = ingest.translate(docs, cache, F.when(F.length("text") % 3 > 0, F.concat(F.lit("new "), F.col("text"))).otherwise("short"))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), "translated_ok")


QUERIES = {f.__name__: f for f in (delete_own, partial_update, mark_rows, rate_rows, append_logins, clear_unanswered, handle_feedback, ban_upsert, ban_user, first_admin, live_sessions, append_feedback, bind_files, log_files, client_errors, rate_tiers, visibility, names_and_keys, qa_answers, merged_log, consistency, page_rules, skip_tallies, article_lookup, running_numbers, translated)}

_AT = f"TIMESTAMP '{NOW}'"
_IN = ", ".join(map(str, _IDS))
_ROUTE = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
_PAGES = """raw AS (SELECT doc_id AS i, CASE WHEN doc_id % 4 > 0 THEN 'T' || doc_id END AS t, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 14 = 0 THEN '/verify/x' ELSE '/a/p' || doc_id || '/' END AS r,
        '---' || chr(10) || 'title: ' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '"T' || doc_id || '"' END || chr(10) || 'route: ' || CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 14 = 0 THEN '/verify/x' ELSE '/a/p' || doc_id || '/' END || chr(10)
        || 'order: ' || CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'x' END || chr(10) || 'visibility: ' || CASE WHEN doc_id % 10 = 0 THEN 'Hidden' ELSE '' END || chr(10) || '---' || chr(10) || '# H' || doc_id || chr(10) || coalesce(text, '') AS text FROM documents),
    src AS (SELECT md5(CASE WHEN i % 25 = 0 THEN '# Index Probe' ELSE text END) AS key, min('f' || i || '.md') AS source_rel FROM raw WHERE i % 13 > 0 GROUP BY 1),
    page AS (SELECT md5(CASE WHEN i % 25 = 0 THEN '# Index Probe' ELSE text END) AS key, CASE WHEN i % 25 > 0 THEN r END AS route, CASE WHEN i % 25 > 0 THEN coalesce(t, 'H' || i) ELSE 'Index Probe' END AS title, CASE WHEN i % 25 > 0 AND i % 2 = 0 THEN i::INT END AS ord, s.source_rel,
        CASE WHEN i % 25 = 0 THEN 'probe' WHEN i % 10 = 0 THEN 'hidden' WHEN r IS NULL THEN 'no_route' WHEN i % 14 = 0 THEN 'probe' WHEN s.key IS NULL THEN 'no_source' END AS skip_reason
        FROM raw LEFT JOIN src s ON s.key = md5(CASE WHEN i % 25 = 0 THEN '# Index Probe' ELSE text END))"""
SQL = {
    "delete_own": f"{_CARDS} SELECT * FROM cards WHERE NOT (id IN ({_IN}) AND user_id = 1)",
    "partial_update": f"{_CARDS} SELECT id, user_id, CASE WHEN id % 10 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN id % 20 = 0 THEN NULL ELSE description END AS description FROM cards",
    "mark_rows": f"{LOG} SELECT id, marked OR id IN ({_IN}) AS marked, CASE WHEN id IN ({_IN}) THEN {_AT} END AS marked_at FROM log",
    "rate_rows": f"""{LOG} SELECT id, CASE WHEN kind = 'ask' THEN id % 2 = 0 ELSE answered END AS answered, CASE WHEN kind = 'ask' THEN CASE WHEN id % 2 = 0 THEN 'solved' ELSE 'unsolved' END ELSE feedback END AS feedback,
        CASE WHEN kind = 'ask' THEN repeat(query, 60)[:255] ELSE '' END AS feedback_reason, CASE WHEN kind = 'ask' THEN {_AT} END AS feedback_at FROM log""",
    "append_logins": f"{LOG} SELECT id, query AS user_agent, kind AS action FROM log UNION ALL SELECT id + 1000000, repeat(query, 50)[:255], repeat(kind, 5)[:16] FROM log WHERE id % 5 = 0",
    "clear_unanswered": f"{LOG} SELECT id, CASE WHEN id % 11 > 0 THEN answered END AS answered FROM log WHERE id % 11 = 0 OR answered",
    "handle_feedback": f"SELECT p_partkey AS id, p_partkey % 2 = 0 OR p_partkey = 21 AS handled, CASE WHEN p_partkey = 21 THEN {_AT} END AS handled_at, CASE WHEN p_partkey = 21 THEN 'boss' ELSE '' END AS handled_by FROM part",
    "ban_upsert": f"""WITH b AS (SELECT '10.0.0.' || s_suppkey AS ip, s_name AS reason FROM supplier WHERE s_suppkey <= 30), n AS (SELECT '10.0.0.' || (s_suppkey % 50) AS ip, arg_max(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'again ' || s_suppkey END, s_suppkey) AS reason FROM supplier WHERE s_suppkey > 20 GROUP BY 1)
        SELECT coalesce(b.ip, n.ip) AS ip, coalesce(nullif(n.reason, ''), b.reason, '') AS reason, {_AT} AS created_at, CASE WHEN n.ip IS NOT NULL THEN {_AT} END AS expires_at FROM b FULL JOIN n ON n.ip = b.ip""",
    "ban_user": f"""SELECT c_custkey AS id, c_acctbal >= 0 AND c_custkey <> 7 AS is_active, CASE WHEN c_custkey = 7 THEN repeat('spam', 100)[:255] ELSE '' END AS ban_reason, CASE WHEN c_custkey = 7 THEN {_AT} END AS banned_at, NULL::BOOLEAN AS is_admin,
        (SELECT count(*) FROM orders WHERE o_custkey <> 7) AS n_left, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS n_kicked FROM customer""",
    "first_admin": "SELECT c_custkey AS id, c_acctbal >= 0 OR c_custkey = 3 AS is_active, c_custkey = (SELECT min(c_custkey) FROM customer) AS is_admin FROM customer",
    "live_sessions": "SELECT o_orderkey AS id, o_orderdate AS expires_at FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'",
    "append_feedback": """WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')[:4000] AS c FROM documents WHERE doc_id % 5 > 0)
        SELECT doc_id AS id, length(c)::INT AS n_chars, md5(c) AS md5, CASE WHEN doc_id % 2 = 0 THEN '故障' ELSE '其他' END AS category, false AS handled FROM t WHERE c <> ''""",
    "bind_files": f"WITH {_FILES}, h AS (SELECT *, id IN (1, 8, 15, 22, 29, 36, 43, 50, 57, 64) AND user_id = 3 AND ref_id IS NULL AS hit FROM files) SELECT id, user_id, CASE WHEN hit THEN 77 ELSE ref_id END AS ref_id, CASE WHEN hit THEN 'answer' ELSE source END AS source FROM h",
    "log_files": f"{LOG}, {_FILES}, g AS (SELECT ref_id, count(*) AS n, string_agg(orig_name, ',' ORDER BY id) AS names FROM files WHERE source = 'query' GROUP BY 1) SELECT id, coalesce(CASE WHEN feedback <> '' THEN n END, 0)::INT AS n_files, coalesce(CASE WHEN feedback <> '' THEN names END, '') AS names FROM log LEFT JOIN g ON g.ref_id = log.id",
    "client_errors": f"""{LOG}, f AS (SELECT *, row_number() OVER (PARTITION BY ip, kind, query, username ORDER BY created_at, id) AS k FROM log), t AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY created_at, id) AS r FROM f WHERE k = 1)
        SELECT id, ip AS session, kind, least(2000, length(query) * 300)::INT AS n_chars FROM t WHERE r <= 5""",
    "rate_tiers": f"{LOG} SELECT id, CASE id % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'heavy' WHEN 3 THEN 'heavy' END AS bucket, CASE WHEN id % 5 = 0 THEN 10 WHEN username <> '' THEN 50 ELSE 30 END::BIGINT AS cap FROM log",
    "visibility": f"{LOG} SELECT id, id % 9 = 0 OR user_id = id % 20 AS visible, user_id = id % 20 OR (ip <> '' AND ip = '10.0.0.' || (id % 50)) AS may_rate FROM log",
    "names_and_keys": """WITH s AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '空' ELSE coalesce(nullif(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), ''), '空')[:6000] END AS g FROM documents)
        SELECT doc_id, regexp_replace(text[:40], '[^a-zA-Z0-9_一-鿿]', '_', 'g') AS safe, CASE WHEN length(text[:12]) > 10 THEN text[:6] || '…' || right(text[:12], 4) ELSE repeat('*', length(text[:12])) END AS masked, repeat('*', length(text[:5])) AS short, md5(g) AS given,
            'text/markdown' AS kind FROM s""",
    "qa_answers": """WITH e AS (SELECT event_id % 300 AS request_id, event_id AS ordinal, ['token', 'sources', 'token', 'done', 'error'][event_id % 5 + 1] AS type, json_extract_string(props, '$.k') AS data FROM events)
        SELECT request_id, arg_min(data, ordinal) FILTER (type = 'sources') AS sources, coalesce(string_agg(data, '' ORDER BY ordinal) FILTER (type = 'token'), '') AS answer, arg_max(type, ordinal) FILTER (type IN ('done', 'error')) AS ended FROM e GROUP BY 1""",
    "merged_log": f"""{LOG.replace("WITH log", "WITH RECURSIVE log")}, h AS MATERIALIZED (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE 'a' || id END AS answer, row_number() OVER (PARTITION BY ip, kind ORDER BY created_at, id) AS n FROM log),
        step AS (SELECT ip, kind, n, id, created_at, id AS anchor_id, created_at AS since FROM h WHERE n = 1
            UNION ALL SELECT h.ip, h.kind, h.n, h.id, h.created_at, CASE WHEN h.created_at - s.since >= INTERVAL 1 HOUR THEN h.id ELSE s.anchor_id END, CASE WHEN h.created_at - s.since >= INTERVAL 1 HOUR THEN h.created_at ELSE s.since END FROM step s JOIN h ON h.ip = s.ip AND h.kind = s.kind AND h.n = s.n + 1)
        SELECT anchor_id AS id, arg_max(sources_count, h.n) AS sources_count, round(arg_max(top_score, h.n), 6) AS top_score, arg_max(answered, h.n) AS answered, coalesce(arg_max(answer, h.n) FILTER (answer <> ''), '') AS answer, count(*) AS repeat_count FROM step JOIN h ON h.id = step.id GROUP BY anchor_id""",
    "consistency": "SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'missing' ELSE 'unlisted' END AS problem FROM documents WHERE (doc_id % 3 > 0) <> (doc_id % 4 > 0)",
    "page_rules": f"WITH {_PAGES} SELECT * FROM page",
    "skip_tallies": f"WITH {_PAGES} SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM page GROUP BY 1",
    "article_lookup": f"""WITH r AS (SELECT page_id, {_ROUTE} AS r, list_filter(string_split({_ROUTE}, '/'), lambda x: x <> '') AS g FROM pages),
        node AS (SELECT DISTINCT array_to_string(g[:i], '/') AS k, i AS depth, g[i] AS last FROM r, unnest(range(1, len(g) + 1)) AS u(i) UNION SELECT '', 0, ''), own AS (SELECT DISTINCT array_to_string(g, '/') AS k FROM r),
        a AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'no' || r ELSE trim(r, '/') END AS asked FROM r), n AS (SELECT asked, array_to_string(list_filter(string_split(asked, '/'), lambda x: x <> ''), '/') AS k FROM a)
        SELECT asked, CASE WHEN own.k IS NOT NULL THEN 't' WHEN node.k = '' THEN '{doctree.ROOT_TITLE}' ELSE node.last END AS title, node.depth <= 1 AS top_level, CASE WHEN n.k = '' THEN 'index.md' ELSE n.k || '.md' END AS path FROM n LEFT JOIN node ON node.k = n.k LEFT JOIN own ON own.k = n.k""",
    "running_numbers": "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS number FROM documents",
    "translated": """WITH c AS (SELECT md5(text) AS key, any_value('cached ' || text[:20]) AS t FROM documents WHERE doc_id % 6 = 0 GROUP BY 1)
        SELECT doc_id, md5(coalesce(c.t, CASE WHEN length(text) % 3 > 0 AND length(trim('new ' || text)) > 10 THEN 'new ' || text ELSE text END)) AS md5, c.t IS NOT NULL OR (length(text) % 3 > 0 AND length(trim('new ' || text)) > 10) AS translated_ok FROM documents LEFT JOIN c ON c.key = md5(text)""",
}
