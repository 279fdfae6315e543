"""Registered queries over conversations: a conversation is a chat log, its turns the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chat, ranking
from quarry.sources.readers import table


def _lines(spark, d):
    """Both dialects: even conversations as name/mes lines, odd ones as role/content."""
    c = table(spark, d, "conversations")
    name = F.concat(F.lit("n"), (F.col("turn") % 3).cast("string"))
    one = F.to_json(F.struct(name.alias("name"), (F.col("role") == "user").alias("is_user"), (F.col("role") == "system").alias("is_system"), F.col("text").alias("mes")))
    two = F.to_json(F.struct("role", F.col("text").alias("content")))
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("turn").alias("n"), F.when(F.col("conv_id") % 2 == 0, one).otherwise(two).alias("line"))


def chat_roles(spark, d):
    found = chat.messages(chat.parse(_lines(spark, d)))
    return found.groupBy("file", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def chat_merge(spark, d):
    rows = table(spark, d, "conversations").withColumn("side", F.when(F.col("turn") % 5 < 3, F.col("role")).otherwise("user"))
    return ranking.runs(rows, ["conv_id"], ["turn"], ["side"]).groupBy("conv_id", "run", "side").agg(F.count("*").alias("n"), F.min("turn").alias("first"))


def speaker_mode(spark, d):
    found = chat.messages(chat.parse(_lines(spark, d)))
    return ranking.mode_first_seen(found, ["file", "role"], chat.clean_name(F.col("name")), "n").select("file", "role", F.col("value").alias("name"), "n")


def chat_prose(spark, d):
    out = chat.prose(_lines(spark, d), {"user": "U"})
    return out.select("file", "n_messages", "n_blocks", "n_empty", F.md5(F.col("text").cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (chat_roles, chat_merge, speaker_mode, chat_prose)}

_MSG = """WITH m AS (SELECT 'c' || conv_id || '.jsonl' AS file, turn AS n, CASE WHEN conv_id % 2 = 1 THEN role WHEN role IN ('user', 'system') THEN role ELSE 'assistant' END AS role,
    CASE WHEN conv_id % 2 = 0 THEN 'n' || (turn % 3) ELSE '' END AS name, coalesce(text, '') AS content FROM conversations)"""
_STRIP = "regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')"
SQL = {
    "chat_roles": f"{_MSG} SELECT file, role, count(*) AS n, sum(length(content))::BIGINT AS n_chars FROM m GROUP BY 1, 2",
    "chat_merge": """WITH s AS (SELECT *, CASE WHEN turn % 5 < 3 THEN role ELSE 'user' END AS side FROM conversations), c AS (SELECT *, coalesce((side IS DISTINCT FROM lag(side) OVER w AND row_number() OVER w > 1)::INT, 0) AS c FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c) SELECT conv_id, run, side, count(*) AS n, min(turn) AS first FROM r GROUP BY 1, 2, 3""",
    "speaker_mode": f"""{_MSG}, c AS (SELECT file, role, name, count(*) AS n, min(n) AS first FROM m WHERE name <> '' GROUP BY 1, 2, 3) SELECT file, role, name, n FROM (SELECT *, row_number() OVER (PARTITION BY file, role ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""",
    "chat_prose": f"""{_MSG}, k AS (SELECT file, n, role, CASE WHEN role = 'user' THEN 'U' WHEN name <> '' THEN name WHEN role = 'assistant' THEN 'AI 角色' ELSE '系统' END AS who, name, {_STRIP} AS t FROM m),
        g AS (SELECT *, coalesce(((who, role) IS DISTINCT FROM lag((who, role)) OVER (PARTITION BY file ORDER BY n))::INT, 1) AS c FROM k WHERE t <> ''), r AS (SELECT *, sum(c) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM g),
        b AS (SELECT file, run, min(who) AS who, count(*) AS k, string_agg(t, chr(10) || chr(10) ORDER BY n) AS t FROM r GROUP BY 1, 2),
        f AS (SELECT file, sum(k)::BIGINT AS n_messages, count(*) AS n_blocks, string_agg('### ' || who || chr(10) || chr(10) || t || chr(10) || chr(10), '' ORDER BY run) AS body FROM b GROUP BY 1),
        o AS (SELECT file, role, name, row_number() OVER (PARTITION BY file, role ORDER BY count(*) DESC, min(n)) AS k FROM k WHERE name <> '' AND t <> '' GROUP BY 1, 2, 3),
        ti AS (SELECT file, string_agg(name, ' × ' ORDER BY role) AS t FROM o WHERE k = 1 AND role IN ('assistant', 'user') GROUP BY 1), e AS (SELECT file, count(*) FILTER (t = '') AS n_empty FROM k GROUP BY 1)
        SELECT f.file, n_messages, n_blocks, n_empty, md5(regexp_replace('# ' || coalesce(ti.t, f.file[:-7]) || chr(10) || chr(10) || '> 由 JSONL 聊天记录自动转换 · 共 ' || n_messages || ' 条消息 / ' || n_blocks || ' 个发言段落' ||
            CASE WHEN n_empty > 0 THEN ' · 跳过 ' || n_empty || ' 条无正文记录' ELSE '' END || chr(10) || chr(10) || body, '\\s+$', '') || chr(10)) AS md5 FROM f JOIN e ON e.file = f.file LEFT JOIN ti ON ti.file = f.file""",
}
