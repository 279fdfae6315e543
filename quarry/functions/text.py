"""Text expressions. All but :func:`normalize_json` stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.segment import convert_phrases

#: The 94 printable ASCII characters and the space, with their full-width forms.
HALF = "".join(chr(c) for c in range(0x20, 0x7F))
FULL = "　" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
TEXT_OPERATIONS = ("fullwidth_to_halfwidth", "halfwidth_to_fullwidth", "remove_empty_lines", "compress_json", "format_json")
CHINESE_DIRECTIONS = ("s2t", "t2s", "s2tw", "tw2s", "s2hk", "hk2s", "tw2sp")
EMPTY_TEXT, LONGEST_INPUT = "空", 6000


def py_strip(col: Column) -> Column:
    """Without Unicode white space at both ends (the built-in trim knows the space alone)."""
    return F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def or_default(col: Column, default: Column | str) -> Column:
    """default where col is null or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def words(text: Column) -> Column:
    """The default tokenizer: lower-cased runs of letters and digits. Any Column -> array<string> may stand in for it."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def embedding_input(text: Column) -> Column:
    """Stripped, a placeholder for blank text, at most 6000 characters."""
    return F.substring(or_default(py_strip(F.coalesce(text, F.lit(""))), EMPTY_TEXT), 1, LONGEST_INPUT)


def to_half_width(text: Column) -> Column:
    return F.translate(text, FULL, HALF)


def to_full_width(text: Column) -> Column:
    return F.translate(text, HALF, FULL)


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)\S")), "\n")


def collapse_space(text: Column) -> Column:
    return py_strip(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_name(text: Column, longest: int = 40) -> Column:
    """What a chunk's source name keeps of a heading: other than letters, digits and Han becomes an underscore."""
    return F.regexp_replace(F.substring(text, 1, longest), r"[^a-zA-Z0-9_一-鿿]", "_")


def digits_or_null(text: Column) -> Column:
    """An integer written as digits with leading minus signs, else null."""
    return F.when(text.rlike(r"^-*[0-9]+$"), text.try_cast("int"))


def masked_key(key: Column) -> Column:
    """First six and last four characters; stars alone for short keys."""
    return F.when(F.length(key) > 10, F.concat(F.substring(key, 1, 6), F.lit("…"), F.right(key, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.length(key)))


def salvage_json(text: Column, many: bool = False) -> Column:
    """Variant of the first object (or, with many, list) in a model's answer; trailing commas are forgiven; null if none."""
    found = F.regexp_extract(text, r"(?s)\[.*?\]" if many else r"(?s)\{.*\}", 0)
    body = F.nullif(found, F.lit(""))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(body, r",\s*([}\]])", "$1")))


def normalize_json(pretty: bool):
    """pandas UDF text -> text: JSON with its own key order, compact or indented by two; null where it does not parse."""

    def one(raw: str | None) -> str | None:
        try:
            data = json.loads(raw)
        except (TypeError, ValueError):
            return None
        return json.dumps(data, ensure_ascii=False, indent=2) if pretty else json.dumps(data, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action="ignore")

    return run


def format_text(text: Column, operation: str) -> Column:
    """struct(text, message): the operation's result, or null with the reason."""
    if operation not in TEXT_OPERATIONS:
        return F.struct(F.lit(None).cast("string").alias("text"), F.lit(f"unsupported operation: {operation}").alias("message"))
    if operation.endswith("_json"):
        out, bad = normalize_json(operation == "format_json")(text), "not valid JSON"
    else:
        out = {"remove_empty_lines": drop_blank_lines, "fullwidth_to_halfwidth": to_half_width, "halfwidth_to_fullwidth": to_full_width}[operation](text)
        bad = "no text"
    return F.struct(out.alias("text"), F.when(out.isNull(), F.lit(bad)).alias("message"))


def convert_chinese(text: Column, direction: str, tables: Mapping[str, Mapping[str, str] | Sequence[Mapping[str, str]]]) -> Column:
    """Script conversion by a direction's table of phrases and characters, or by several in turn (phrases, then regional variants), as the
    caller has them; no dictionary comes with the library. Of what fits at a place the longest phrase counts."""
    if direction not in CHINESE_DIRECTIONS:
        raise ValueError(f"unsupported direction: {direction}")
    if direction not in tables:
        raise LookupError(f"no table of characters for {direction}")
    chain = tables[direction]
    return convert_phrases(text, [chain] if isinstance(chain, Mapping) else chain)
