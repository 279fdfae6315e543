"""Chat logs: lines to messages in two dialects, speaker names, merged runs, prose.

A log file is a key; its lines carry their number. Lines become messages row by row; only names, runs and the final join of a
file's own text group by file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.lorebook import kind_of
from quarry.functions.text import or_default, py_strip
from quarry.operators.ranking import mode_first_seen, runs

#: Names that stand for no name, defaults.
PLACEHOLDERS = ("", "unused", "user", "assistant", "null", "none", "unknown", "未命名")
YOU, THEM, SYSTEM, UNTITLED = "你", "AI 角色", "系统", "聊天记录"


def _s(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def clean_name(name: Column) -> Column:
    """Stripped; null for placeholders."""
    s = py_strip(F.coalesce(name, F.lit("")))
    return F.when(~F.lower(s).isin(*PLACEHOLDERS), s)


def parse(lines: DataFrame, file_col: str = "file", line_col: str = "line", order: str = "n") -> DataFrame:
    """(file, n, v, bad): non-blank lines as variants; bad where a line is not JSON."""
    some = lines.where(F.col(line_col).rlike(r"(?U)\S")).select(F.col(file_col).alias("file"), F.col(order).alias("n"), F.try_parse_json(F.col(line_col)).alias("v"))
    return some.withColumn("bad", F.col("v").isNull())


def messages(parsed: DataFrame) -> DataFrame:
    """(file, n, role, name, content, reasoning) of lines that are messages."""
    v = F.col("v")
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    truth = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False))
    first = has("mes")
    parts = F.try_variant_get(v, "$.content", "array<variant>")
    listed = kind_of(F.try_variant_get(v, "$.content", "variant")) == "array"
    text = F.when(listed, F.array_join(F.transform(parts, lambda p: _s(p, "$.text")), "")).otherwise(_s(v, "$.content"))
    role = F.when(first, F.when(truth("is_system"), "system").when(truth("is_user"), "user").otherwise("assistant")).otherwise(or_default(_s(v, "$.role"), "unknown"))
    rows = parsed.where(~F.col("bad") & (kind_of(v) == "object")).where(first | has("content") | has("role"))
    return rows.select("file", "n", role.alias("role"), _s(v, "$.name").alias("name"), F.when(first, _s(v, "$.mes")).otherwise(text).alias("content"), F.when(first, _s(v, "$.extra.reasoning")).otherwise(_s(v, "$.reasoning")).alias("reasoning"))


def header(parsed: DataFrame) -> DataFrame:
    """(file, character_name, user_name) of each file's first line that has either."""
    v = F.col("v")
    rows = parsed.where(~F.col("bad")).select("file", "n", F.try_variant_get(v, "$.character_name", "string").alias("c"), F.try_variant_get(v, "$.user_name", "string").alias("u"))
    best = rows.where("c is not null or u is not null").groupBy("file").agg(F.min_by(F.struct("c", "u"), "n").alias("m"))
    return best.select("file", clean_name(F.col("m.c")).alias("character_name"), clean_name(F.col("m.u")).alias("user_name"))


def speakers(found: DataFrame, head: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """messages with ``who``: the map by name, by role, the own name, the header's, a default."""
    known = F.create_map(*[F.lit(x) for kv in (mapping or {}).items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    own = F.nullif(py_strip(F.col("name")), F.lit(""))
    by = lambda k: F.nullif(F.try_element_at(known, F.lit(k)), F.lit(""))
    who = F.coalesce(
        F.try_element_at(known, own),
        F.when(F.col("role") == "user", F.coalesce(by("user"), own, "user_name", F.lit(YOU))),
        F.when(F.col("role") == "assistant", F.coalesce(by("assistant"), own, "character_name", F.lit(THEM))),
        own, F.lit(SYSTEM),
    )
    return found.join(head, "file", "left").withColumn("who", who).drop("character_name", "user_name")


def blocks(spoken: DataFrame) -> DataFrame:
    """(file, run, who, role, parts, reasoning): consecutive messages of one speaker and role, in order."""
    some = spoken.where(F.col("content").rlike(r"(?U)\S")).withColumns({"content": py_strip(F.col("content")), "reasoning": py_strip(F.col("reasoning"))})
    marked = runs(some, ["file"], ["n"], ["who", "role"])
    got = marked.groupBy("file", "run", "who", "role").agg(F.array_sort(F.collect_list(F.struct("n", "content", "reasoning"))).alias("m"))
    return got.select("file", "run", "who", "role", F.transform("m", lambda x: x["content"]).alias("parts"), F.filter(F.transform("m", lambda x: x["reasoning"]), lambda r: r != "").alias("reasoning"))


def title(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """(file, title): character and user by header or by their commonest name; else the file name up to the first dash or at sign."""
    common = mode_first_seen(found.where(F.col("content").rlike(r"(?U)\S")), ["file", "role"], clean_name(F.col("name")), "n")
    per = lambda role, out: common.where(F.col("role") == role).select("file", F.col("value").alias(out))
    rows = parsed.select("file").distinct().join(header(parsed), "file", "left").join(per("assistant", "_c"), "file", "left").join(per("user", "_u"), "file", "left")
    stem = F.trim(F.regexp_replace(F.regexp_replace("file", r"^.*/", ""), r"\.[^.]*$", ""))
    name = F.concat_ws(" × ", F.coalesce("character_name", "_c"), F.coalesce("user_name", "_u"))
    return rows.select("file", or_default(name, or_default(F.split(stem, r"\s*[-—@]\s*")[0], or_default(stem, UNTITLED))).alias("title"))


def prose(lines: DataFrame, mapping: Mapping[str, str] | None = None, include_reasoning: bool = False) -> DataFrame:
    """(file, text, n_messages, n_blocks, n_empty, n_bad): each log as a readable text; text null where it has no message."""
    parsed = parse(lines)
    found = messages(parsed)
    merged = blocks(speakers(found, header(parsed), mapping))
    head = F.concat(F.lit("### "), "who", F.lit("\n\n"))
    think = F.when(F.lit(include_reasoning) & (F.size("reasoning") > 0), F.concat(F.array_join(F.transform("reasoning", lambda r: F.concat(F.lit("> *思考*："), r)), "\n"), F.lit("\n\n"))).otherwise("")
    shown = merged.select("file", "run", F.size("parts").alias("k"), F.concat(head, think, F.array_join("parts", "\n\n"), F.lit("\n\n")).alias("t"))
    body = shown.groupBy("file").agg(F.sum("k").alias("n_messages"), F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "t"))), lambda x: x["t"]), "").alias("body"))
    empty = found.groupBy("file").agg(F.count_if(~F.col("content").rlike(r"(?U)\S")).alias("n_empty"))
    bad = parsed.groupBy("file").agg(F.count_if("bad").alias("n_bad"))
    rows = title(parsed, found).join(bad, "file").join(empty, "file", "left").join(body, "file", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    skipped = lambda c, what: F.when(n(c) > 0, F.concat(F.lit(" · 跳过 "), n(c).cast("string"), F.lit(what))).otherwise("")
    lead = F.concat(F.lit("# "), "title", F.lit("\n\n> 由 JSONL 聊天记录自动转换 · 共 "), F.col("n_messages").cast("string"), F.lit(" 条消息 / "), F.col("n_blocks").cast("string"), F.lit(" 个发言段落"), skipped("n_empty", " 条无正文记录"), skipped("n_bad", " 行无法解析的内容"), F.lit("\n\n"))
    text = F.concat(F.regexp_replace(F.concat(lead, "body"), r"(?U)\s+$", ""), F.lit("\n"))
    return rows.select("file", text.alias("text"), n("n_messages").alias("n_messages"), n("n_blocks").alias("n_blocks"), n("n_empty").alias("n_empty"), "n_bad")
