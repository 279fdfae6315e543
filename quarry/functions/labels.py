"""Rules that label requests, queries, feedback and uploads: plain Catalyst expressions, every tunable a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import collapse_space, or_default

#: Fixed values.
LOOPBACK = ("127.0.0.1", "::1", "localhost", "localhost.localdomain", "")
FEEDBACK_KINDS = ("solved", "unsolved", "irrelevant")
FEEDBACK_CATEGORIES = ("建议", "体验", "故障", "其他")
UPLOAD_TYPES = {
    "md": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
AUTH_PATHS = ("/api/auth/login", "/api/auth/register")
HEAVY_PATHS = (
    "/api/rag/", "/api/cards/generate", "/api/cards/suggest-tags", "/api/worldbooks/generate", "/api/worldbooks/suggest-entries", "/api/tools/",
    "/api/llm/test", "/api/update/", "/api/feedback", "/api/errors", "/api/attachments", "/api/docs/search",
)


@dataclass(frozen=True)
class Tunables:
    answered_at: float = 0.45
    log_rows: int = 20_000
    dedup_seconds: int = 60
    rate_window_s: int = 60
    rate_anonymous: int = 30
    rate_user: int = 50
    rate_auth: int = 10
    slow_ms: int = 3000
    file_mb: int = 20
    files_per_submit: int = 3
    files_per_ip_day: int = 5
    files_per_user: int = 50
    total_mb: int = 1024
    alert_window_s: int = 600
    alerts_per_window: int = 3
    alert_cooldown_s: int = 300

    @classmethod
    def of(cls, settings: Mapping[str, str]) -> Tunables:
        """From text settings; missing, empty and unreadable ones keep their default."""
        got = {}
        for f in fields(cls):
            try:
                got[f.name] = type(f.default)(settings.get(f.name, ""))
            except ValueError:
                pass
        return cls(**got)


DEFAULTS = Tunables()


def answered(sources_count: Column, top_score: Column, at: float = DEFAULTS.answered_at) -> Column:
    """Some source was found and the best is good enough; nulls count as not answered."""
    return F.coalesce((sources_count > 0) & (top_score >= at), F.lit(False))


def feedback_kind(kind: Column) -> Column:
    return F.when(kind.isin(*FEEDBACK_KINDS), kind).otherwise("unsolved")


def answered_after_feedback(label: Column, feedback: Column) -> Column:
    """A user's word overrides the label; no feedback leaves it."""
    return F.when(or_default(feedback, "") == "", label).otherwise(feedback_kind(feedback) == "solved")


def feedback_category(category: Column) -> Column:
    name = F.trim(F.coalesce(category, F.lit("")))
    return F.when(name.isin(*FEEDBACK_CATEGORIES), name).otherwise(FEEDBACK_CATEGORIES[-1])


def normalize_ip(ip: Column) -> Column:
    """IPv4 addresses written as IPv6 lose their prefix."""
    bare = F.trim(F.coalesce(ip, F.lit("")))
    return F.regexp_replace(bare, r"(?i)^::ffff:(?=[^:]*\.)", "")


def is_loopback(ip: Column) -> Column:
    return normalize_ip(ip).isin(*LOOPBACK)


def client_ip(forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """The last hop named by the forwarding header, else the proxy's header, else the peer."""
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(hops, F.lit(-1)), F.nullif(F.trim(real_ip), F.lit("")), peer, F.lit("unknown"))


def url_template(path: Column) -> Column:
    return F.regexp_replace(path, r"/\d+", "/{id}")


def severity(status: Column, ms: Column, slow_ms: int = DEFAULTS.slow_ms) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").when(ms >= slow_ms, "warn").otherwise("info")


def starts_with_any(path: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def rate_bucket(path: Column) -> Column:
    """auth before heavy; null for paths without a limit."""
    return F.when(starts_with_any(path, AUTH_PATHS), "auth").when(starts_with_any(path, HEAVY_PATHS), "heavy")


def rate_cap(bucket: Column, signed_in: Column, t: Tunables = DEFAULTS) -> Column:
    return F.when(bucket == "auth", t.rate_auth).when(signed_in, t.rate_user).otherwise(min(t.rate_user, t.rate_anonymous))


def not_expired(expires_at: Column, now: Column) -> Column:
    """No expiry, or one not before now."""
    return expires_at.isNull() | (expires_at >= now)


def owner_or_admin(owner: Column, user: Column, admin: Column) -> Column:
    return F.coalesce(admin, F.lit(False)) | F.coalesce(owner == user, F.lit(False))


def may_rate(row_user: Column, row_ip: Column, user: Column, ip: Column) -> Column:
    """Feedback on a logged query: the same user, or the same address if that is not empty."""
    return F.coalesce(row_user == user, F.lit(False)) | F.coalesce((normalize_ip(row_ip) == normalize_ip(ip)) & (row_ip != ""), F.lit(False))


def file_type(name: Column, types: Mapping[str, str] = UPLOAD_TYPES) -> Column:
    """The MIME type of an allowed, lower-cased suffix; null for others."""
    known = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)))


def source_digest(sources: Column) -> Column:
    """JSON of the first five sources: name (120 characters), score (4 decimals, 0 if none), one-line preview (80 characters)."""
    one = lambda s: F.struct(
        F.substring(F.coalesce(s["source"], F.lit("")), 1, 120).alias("source"),
        F.round(F.coalesce(s["score"], F.lit(0.0)), 4).alias("score"),
        F.substring(collapse_space(F.coalesce(s["content"], F.lit(""))), 1, 80).alias("preview"),
    )
    return F.to_json(F.transform(F.slice(F.coalesce(sources, F.array()), 1, 5), one))


def tag_summary(tags: Column, text: Column | None = None) -> Column:
    """The first six tags in a line; where there is no list, the first 80 characters of ``text``."""
    line = F.array_join(F.slice(tags, 1, 6), "、")
    return line if text is None else F.coalesce(line, F.substring(F.coalesce(text, F.lit("")), 1, 80))


def quota_gate(total_bytes: Column, file_bytes: Column, files: Column, user_files: Column, ip_files_today: Column, t: Tunables = DEFAULTS) -> Column:
    """The first upload gate that fails, null if all pass: total, file, submit, user, ip_day."""
    mb = 1024 * 1024
    return (
        F.when(total_bytes + file_bytes > t.total_mb * mb, "total")
        .when(file_bytes > t.file_mb * mb, "file")
        .when(files > t.files_per_submit, "submit")
        .when(user_files + files > t.files_per_user, "user")
        .when(ip_files_today + files > t.files_per_ip_day, "ip_day")
    )
