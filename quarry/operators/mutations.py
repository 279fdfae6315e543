"""Changes to stored tables, as DataFrames of the new state: Parquet has no row update, so the writer replaces what changed.

Ids to change come as a small DataFrame or list; a missing id changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.labels import answered_after_feedback, feedback_kind, normalize_ip
from quarry.functions.text import or_default, py_strip


def last_per_key(changes: DataFrame, key: str, at: str | None = None) -> DataFrame:
    """One row of each key: the last by ``at``, equal ones by all their columns; without ``at`` the largest by all."""
    by = F.struct(*([at] if at else []), *[F.to_json(F.struct(c)) for c in changes.columns])
    return changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), by).alias("_row")).select("_row.*")


def append(table: DataFrame, rows: DataFrame, cut: Mapping[str, int] | None = None) -> DataFrame:
    """Both, by name; missing columns are null. ``cut`` gives longest lengths of text columns."""
    new = rows.withColumns({c: F.substring(F.col(c), 1, n) for c, n in (cut or {}).items() if c in rows.columns})
    return table.unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, ids: Sequence[int], owner: int | None = None, admin: bool = True, only: Column | None = None) -> DataFrame:
    """Without the rows of these ids that the owner (or an admin) may remove and that ``only`` allows."""
    gone = F.col("id").isin(*ids) if ids else F.lit(False)
    if not admin:
        gone = gone & F.coalesce(F.col("user_id") == owner, F.lit(False)) & (only if only is not None else F.lit(True))
    return table.where(~F.coalesce(gone, F.lit(False)))


def update(table: DataFrame, patch: DataFrame, key: str = "id", given: str = "given", at: str | None = None) -> DataFrame:
    """Partial update: ``patch`` has the key, new values and ``given``, the names of the columns that were supplied (null is a value).

    Of several patches of a row the last one by ``at`` holds; a row is never doubled.
    """
    new = last_per_key(patch, key, at).select(key, given, *[F.col(c).alias(f"_{c}") for c in patch.columns if c not in (key, given)])
    joined = table.join(new, key, "left")
    out = [F.when(F.array_contains(given, F.lit(c)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in new.columns else F.col(c) for c in table.columns]
    return joined.select(*out)


def mark(log: DataFrame, ids: Sequence[int], marked: bool, now: Column) -> DataFrame:
    hit = F.col("id").isin(*ids) if ids else F.lit(False)
    return log.withColumns({"marked": F.when(hit, F.lit(marked)).otherwise(F.col("marked")), "marked_at": F.when(hit, now if marked else F.lit(None)).otherwise(F.col("marked_at"))})


def rate(log: DataFrame, ratings: DataFrame, now: Column, at: str | None = None) -> DataFrame:
    """log after users' feedback (id, kind, reason): the label follows it; the last rating of a query by ``at`` holds."""
    new = last_per_key(ratings, "id", at).select("id", feedback_kind(F.col("kind")).alias("_kind"), F.substring(F.coalesce("reason", F.lit("")), 1, 255).alias("_reason"))
    out = log.join(new, "id", "left")
    hit = F.col("_kind").isNotNull()
    return out.withColumns({
        "answered": F.when(hit, answered_after_feedback(F.col("answered"), F.col("_kind"))).otherwise(F.col("answered")),
        "feedback": F.when(hit, F.col("_kind")).otherwise(F.col("feedback")),
        "feedback_reason": F.when(hit, F.col("_reason")).otherwise(F.col("feedback_reason")),
        "feedback_at": F.when(hit, now).otherwise(F.col("feedback_at")),
    }).select(*log.columns)


def clear_log(log: DataFrame, only_unanswered: bool) -> DataFrame:
    """Emptied, or without the unanswered; rows never labelled stay."""
    return log.where(F.coalesce(F.col("answered"), F.lit(True))) if only_unanswered else log.where("false")


def handle(feedback: DataFrame, feedback_id: int, handled: bool, by: str, now: Column) -> DataFrame:
    hit = F.col("id") == feedback_id
    new = {"handled": F.lit(handled), "handled_at": now if handled else F.lit(None), "handled_by": F.lit(by if handled else "")}
    return feedback.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def ban_ips(bans: DataFrame, new: DataFrame, now: Column, at: str | None = None) -> DataFrame:
    """Upsert by address: an empty reason keeps the old one, the expiry is overwritten, loopback is refused; the last ban of an address by ``at`` holds."""
    from quarry.functions.labels import is_loopback

    known = new.where(~is_loopback(F.col("ip"))).withColumn("ip", normalize_ip(F.col("ip")))
    n = last_per_key(known, "ip", at).select("ip", F.col("reason").alias("_reason"), F.col("expires_at").alias("_expires"), F.lit(True).alias("_new"))
    out = bans.select("ip", "reason", "created_at", "expires_at").join(n, "ip", "full_outer")
    return out.select(
        "ip", or_default(F.col("_reason"), F.coalesce("reason", F.lit(""))).alias("reason"), F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("_new"), F.col("_expires")).otherwise(F.col("expires_at")).alias("expires_at"),
    )


def ban_user(users: DataFrame, sessions: DataFrame, user_id: int, reason: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, sessions, one row of n_kicked): inactive with the reason, all sessions gone; those without a user stay."""
    hit = F.col("id") == user_id
    new = {"is_active": F.lit(False), "ban_reason": F.lit(reason[:255]), "banned_at": now}
    return users.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}), sessions.where(~F.col("user_id").eqNullSafe(user_id)), sessions.where(F.col("user_id") == user_id).agg(F.count("*").alias("n_kicked"))


def unban_user(users: DataFrame, user_id: int) -> DataFrame:
    hit = F.col("id") == user_id
    new = {"is_active": F.lit(True), "ban_reason": F.lit(""), "banned_at": F.lit(None)}
    return users.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def first_user_is_admin(users: DataFrame) -> DataFrame:
    """is_admin is true for the smallest id, besides whoever has it."""
    least = users.agg(F.min("id").alias("_least"))
    return users.crossJoin(F.broadcast(least)).withColumn("is_admin", F.coalesce("is_admin", F.lit(False)) | (F.col("id") == F.col("_least"))).drop("_least")


def drop_expired(sessions: DataFrame, now: Column) -> DataFrame:
    """Without the sessions whose time is over; those without an expiry stay."""
    return sessions.where(~F.coalesce(F.col("expires_at") < now, F.lit(False)))


def feedback_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Feedback to append: blank content gives no row, content at most 4000 characters, unknown categories become the default."""
    from quarry.functions.labels import feedback_category

    text = py_strip(F.coalesce("content", F.lit("")))
    return rows.where(text != "").withColumns({"content": F.substring(text, 1, 4000), "category": feedback_category(F.col("category")), "created_at": now, "handled": F.lit(False)})


def bind_attachments(attachments: DataFrame, ids: Sequence[int], user_id: int, source: str, ref_id: int) -> DataFrame:
    """The first ten ids that are the user's own and unbound get (source, ref_id)."""
    hit = F.col("id").isin(*ids[:10]) & (F.col("user_id") == user_id) & F.col("ref_id").isNull() if ids else F.lit(False)
    return attachments.withColumns({"source": F.when(hit, F.lit(source)).otherwise(F.col("source")), "ref_id": F.when(hit, F.lit(ref_id).cast("long")).otherwise(F.col("ref_id"))})
