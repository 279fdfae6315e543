"""Usage analytics over query logs, logins, users, uploads and requests.

Inputs carry the columns of the reference's tables (created_at timestamp, ip, user_id, username, ...). Every rule that looks at
the clock takes ``now``. Aggregates combine on the map side; per-key lists are cut to their bound before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.labels import DEFAULTS, Tunables, normalize_ip, not_expired, quota_gate, tag_summary
from quarry.functions.text import or_default
from quarry.operators.ranking import first_per_key, page, top_per_key

UNKNOWN_IP = "(未知)"


def filter_log(log: DataFrame, only_unanswered: bool = False, feedback: str = "", marked_only: bool = False, ip: str = "", username: str = "", kind: str = "") -> DataFrame:
    """The conjunction of the switches that are set; unanswered means false, not null. Plain predicates, so they reach the scan."""
    out = log
    if only_unanswered:
        out = out.where(~F.col("answered"))
    if feedback:
        out = out.where(F.col("feedback") == feedback)
    if marked_only:
        out = out.where(F.col("marked"))
    if ip:
        out = out.where(F.col("ip") == normalize_ip(F.lit(ip)))
    if username:
        out = out.where(F.col("username") == username)
    if kind:
        out = out.where(F.col("kind") == kind)
    return out


def log_page(log: DataFrame, number: int, size: int, **switches) -> DataFrame:
    return page(filter_log(log, **switches), [F.desc("id")], number, size)


def log_count(log: DataFrame, **switches) -> DataFrame:
    """(total) over the filtered rows, for paging."""
    return filter_log(log, **switches).agg(F.count("*").alias("total"))


def since_days(ts: Column, now: Column, days: int) -> Column:
    return ts >= now - F.make_interval(days=F.lit(max(1, days)))


def since_midnight(ts: Column, now: Column) -> Column:
    return ts >= F.date_trunc("day", now)


def active_ips(log: DataFrame, now: Column, days: int = 7, limit: int | None = 50, bans: DataFrame | None = None) -> DataFrame:
    """(ip, n, n_users, usernames, last_at[, banned]): busiest addresses of the last days.

    Names are joined in order and cut at 200 characters; 101 names a key fill that, so no key gathers more.
    """
    rows = log.where(since_days(F.col("created_at"), now, days) & (F.col("ip") != "")).select("ip", F.nullif("username", F.lit("")).alias("username"), "created_at")
    pairs = rows.groupBy("ip", "username").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))
    sums = pairs.groupBy("ip").agg(F.sum("n").alias("n"), F.count("username").alias("n_users"), F.max("last_at").alias("last_at"))
    some = top_per_key(pairs.where("username is not null").select("ip", "username"), ["ip"], [F.col("username")], 101)
    names = some.groupBy("ip").agg(F.substring(F.array_join(F.array_sort(F.collect_list("username")), ","), 1, 200).alias("usernames"))
    out = sums.join(names, "ip", "left").select("ip", "n", "n_users", F.coalesce("usernames", F.lit("")).alias("usernames"), "last_at")
    if bans is not None:
        active = bans.where(not_expired(F.col("expires_at"), now)).select("ip", F.lit(True).alias("banned")).distinct()
        out = out.join(active, "ip", "left").withColumn("banned", F.coalesce("banned", F.lit(False)))
    return out if limit is None else out.orderBy(F.desc("n"), "ip").limit(limit)


def login_summary(logins: DataFrame, newest: int = 500, limit: int = 20) -> DataFrame:
    """(user_id, ip, n, first_at, last_at, agents): addresses of each user's newest logins, the latest ``limit`` of them, two agents each."""
    some = top_per_key(logins, ["user_id"], [F.desc("id")], newest)
    agent = F.nullif(F.substring(F.coalesce("user_agent", F.lit("")), 1, 80), F.lit(""))
    per = some.groupBy("user_id", or_default(F.col("ip"), UNKNOWN_IP).alias("ip")).agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.collect_set(agent).alias("a"))
    out = per.select("user_id", "ip", "n", "first_at", "last_at", F.array_join(F.slice(F.array_sort("a"), 1, 2), "；").alias("agents"))
    return top_per_key(out, ["user_id"], [F.desc("last_at"), F.col("ip")], limit)


def newest_logins(logins: DataFrame, limit: int = 50, user_id: int | None = None) -> DataFrame:
    some = logins if user_id is None else logins.where(F.col("user_id") == user_id)
    return some.orderBy(F.desc("id")).limit(max(1, min(200, limit)))


def user_rollup(users: DataFrame, sessions: DataFrame, log: DataFrame) -> DataFrame:
    """users with n_sessions, n_queries (0 if none) and last_query; both sides are aggregated before they are joined."""
    s = sessions.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n_sessions"))
    q = log.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n_queries"), F.max("created_at").alias("last_query"))
    out = users.join(s, "user_id", "left").join(q, "user_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_sessions", "n_queries")})


def overview(log: DataFrame, users: DataFrame, bans: DataFrame, now: Column, t: Tunables = DEFAULTS) -> DataFrame:
    """One row of totals: one pass a table."""
    q = log.agg(
        F.count("*").alias("queries_total"), F.count_if(since_midnight(F.col("created_at"), now)).alias("queries_today"),
        F.count_if(F.coalesce("answered", F.lit(False))).alias("queries_answered"), F.count_if(~F.col("answered")).alias("queries_unanswered"),
        F.count_if(F.col("marked")).alias("queries_marked"), F.count_if(F.col("feedback") != "").alias("queries_rated"),
        F.coalesce(F.sum("repeat_count"), F.lit(0)).alias("queries_with_repeats"),
    )
    u = users.agg(F.count("*").alias("users_total"), F.count_if(~F.col("is_active")).alias("users_banned"))
    b = bans.agg(F.count_if(not_expired(F.col("expires_at"), now)).alias("ips_banned"))
    return q.crossJoin(u).crossJoin(b).withColumn("threshold", F.lit(t.answered_at))


def log_with_attachments(log: DataFrame, attachments: DataFrame) -> DataFrame:
    """log with ``files`` (array of id, name in id order) for rows with feedback, empty for the rest."""
    wanted = log.where(F.coalesce("feedback", F.lit("")) != "").select(F.col("id").alias("ref_id"))
    files = attachments.where("source = 'query'").join(wanted, "ref_id", "left_semi").groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("id", "orig_name"))).alias("files"))
    out = log.join(files.withColumnRenamed("ref_id", "id"), "id", "left")
    return out.withColumn("files", F.coalesce("files", F.array().cast(files.schema["files"].dataType)))


def storage_usage(attachments: DataFrame, limit_mb: int = DEFAULTS.total_mb) -> DataFrame:
    """(files, used_bytes, used_mb, percent), 0 percent without a limit."""
    got = attachments.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("used_bytes"))
    mb = F.col("used_bytes") / 1048576
    percent = F.round(100 * mb / limit_mb, 2) if limit_mb else F.lit(0.0)
    return got.select("files", "used_bytes", F.round(mb, 2).alias("used_mb"), percent.alias("percent"))


def quota_snapshot(uploads: DataFrame, attachments: DataFrame, now: Column, t: Tunables = DEFAULTS) -> DataFrame:
    """uploads (upload_id, user_id, ip, bytes, files) with ``refused``: the first gate that fails against what is stored."""
    total = attachments.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    users = attachments.groupBy("user_id").agg(F.count("*").alias("_user"))
    today = attachments.where(since_midnight(F.col("created_at"), now)).groupBy("ip").agg(F.count("*").alias("_ip"))
    both = uploads.join(users, "user_id", "left").join(today, "ip", "left").crossJoin(F.broadcast(total))
    gate = quota_gate(F.col("_total"), F.col("bytes"), F.col("files"), F.coalesce("_user", F.lit(0)), F.coalesce("_ip", F.lit(0)), t)
    return both.withColumn("refused", gate).select(*uploads.columns, "refused")


def request_metrics(requests: DataFrame, slow_ms: int = DEFAULTS.slow_ms) -> DataFrame:
    """(method, path, status, n, total_ms, n_slow) by normalised path."""
    return requests.groupBy("method", "path", "status").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.count_if(F.col("ms") >= slow_ms).alias("n_slow"))


def llm_usage(calls: DataFrame) -> DataFrame:
    """(calls, prompt, completion, total): a missing or zero total falls back to the sum of the parts."""
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    total = F.coalesce(F.nullif("total_tokens", F.lit(0)), p + c)
    return calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum(p), F.lit(0)).alias("prompt"), F.coalesce(F.sum(c), F.lit(0)).alias("completion"), F.coalesce(F.sum(total), F.lit(0)).alias("total"))


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def search_items(items: DataFrame, user_id: int | None = None, search: str = "", tags: Sequence[str] = ()) -> DataFrame:
    """A tenant's cards or books whose name or description holds the term (any case, no wildcards) and that have one of the tags."""
    out = items if user_id is None else items.where(F.col("user_id") == user_id)
    if search:
        term = F.lit(search.lower())
        out = out.where(F.contains(F.lower("name"), term) | F.contains(F.lower(F.coalesce("description", F.lit(""))), term))
    wanted = [t for t in tags if t]
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, wanted)))) if wanted else out


def items_page(items: DataFrame, number: int, size: int, **search) -> DataFrame:
    return page(search_items(items, **search), [F.desc("updated_at"), F.desc("id")], number, size)


def consecutive_failures(checks: DataFrame, restart_at: int = 2) -> DataFrame:
    """checks (target, at, ok) with ``failures`` in a row so far and ``restart`` where that reaches the bound (counting starts anew)."""
    from pyspark.sql import Window

    w = Window.partitionBy("target").orderBy("at")
    marked = checks.withColumn("_ok", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("target", "_ok").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((~F.col("ok")).cast("int")).over(in_run)
    step = F.when(n > 0, (n - 1) % restart_at + 1).otherwise(0)
    return marked.withColumn("failures", step).withColumn("restart", F.col("failures") == restart_at).drop("_ok")


def answers(events: DataFrame) -> DataFrame:
    """(request_id, sources, answer, ended): a Q&A event stream folded into one row a request; tokens in ordinal order."""
    token = F.when(F.col("type") == "token", F.struct("ordinal", "data"))
    parts = F.array_sort(F.collect_list(token))
    return events.groupBy("request_id").agg(
        F.min_by(F.when(F.col("type") == "sources", F.col("data")), F.when(F.col("type") == "sources", F.col("ordinal"))).alias("sources"),
        F.array_join(F.transform(parts, lambda x: x["data"]), "").alias("answer"),
        F.max_by("type", F.when(F.col("type").isin("done", "error"), F.col("ordinal"))).alias("ended"),
    )


def client_errors(errors: DataFrame, most: int = 20) -> DataFrame:
    """Errors of a page session: first of each (kind, message, page), the first ``most`` sent; long fields cut."""
    once = first_per_key(errors, ["session", "kind", "message", "page"], ["created_at", "id"])
    cut = {"message": 2000, "stack": 8000, "page": 255, "source": 255, "user_agent": 255}
    sent = top_per_key(once, ["session"], [F.col("created_at"), F.col("id")], most)
    return sent.withColumns({c: F.substring(F.col(c), 1, n) for c, n in cut.items() if c in errors.columns})


def ban_list(bans: DataFrame, now: Column, number: int = 1, size: int = 50, include_expired: bool = False) -> DataFrame:
    """A page of bans with ``active``, newest first."""
    rows = bans.withColumn("active", not_expired(F.col("expires_at"), now))
    return page(rows if include_expired else rows.where("active"), [F.desc("created_at"), F.desc("id")], number, size)


def user_cards(cards: DataFrame) -> DataFrame:
    """What an overseer sees of cards: (user_id, id, name, tags as one line, has_image, updated_at). A user's are newest first by id."""
    return cards.select("user_id", "id", "name", tag_summary(F.col("tags")).alias("tags"), (or_default(F.col("image_path"), "") != "").alias("has_image"), "updated_at")


def user_books(books: DataFrame, entries: str = "entries") -> DataFrame:
    """The same for lore books: (user_id, id, name, n_entries, updated_at); entries are a JSON text, and 0 if that is no list."""
    listed = F.try_parse_json(F.col(entries))
    n = F.size(F.try_variant_get(listed, "$", "array<variant>"))
    return books.select("user_id", "id", "name", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("n_entries"), "updated_at")
