"""Lore-book documents (variant columns): entries at any of the known places, and conversion between the two layouts.

Fields read leniently: a missing field takes its default, a scalar counts as a list of one, blank strings as none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Objects that wrap the entries.
WRAPPERS = ("data", "character_book", "world_book")
ENTRY = "array<variant>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    """object, array or the type's name."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0))


def _ordered(v: Column) -> Column:
    """Values of an object whose keys sort as numbers do when written without leading zeros: by length, then text."""
    pairs = F.transform(F.map_entries(_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    keys = F.array_sort(F.transform(pairs, lambda p: F.struct(p["n"], p["k"])))
    return F.transform(keys, lambda k: F.try_element_at(_get(v, "$", "map<string,variant>"), k["k"]))


def _objects(list_: Column) -> Column:
    return F.filter(list_, lambda e: kind_of(e) == "object")


def entries(doc: Column) -> Column:
    """array<variant> of entry objects: a bare list, or ``entries`` (list or object) under at most two wrappers; empty if none."""
    none = F.array().cast(ENTRY)

    def at(node: Column, levels: int) -> Column:
        # Nodes are paths, so that one expression looks at them all.
        found = _get(node, "$.entries", "variant")
        here = F.when(kind_of(found) == "array", _objects(_get(found, "$", ENTRY))).when(kind_of(found) == "object", _objects(_ordered(found))).otherwise(none)
        below = none
        if levels > 1:
            for w in reversed(WRAPPERS):
                inner = _get(node, f"$.{w}", "variant")
                below = F.when(kind_of(inner) == "object", at(inner, levels - 1)).otherwise(below)
        return F.when(found.isNotNull(), here).otherwise(below)

    return F.when(kind_of(doc) == "array", _objects(_get(doc, "$", ENTRY))).when(kind_of(doc) == "object", at(doc, 3)).otherwise(none)


def as_list(v: Column) -> Column:
    """array<string>: lists as they are, a non-blank scalar as one item, null and blank as none."""
    one = _get(v, "$", "string")
    none = F.array().cast("array<string>")
    return F.when(kind_of(v) == "array", F.transform(_get(v, "$", ENTRY), lambda x: _get(x, "$", "string"))).when(one.isNull() | ~one.rlike(r"(?U)\S"), none).otherwise(F.array(one))


def _field(e: Column, *names: str) -> Column:
    return F.coalesce(*[_get(e, f"$.{n}", "variant") for n in names])


def _text(e: Column, name: str) -> Column:
    return F.coalesce(_get(e, f"$.{name}", "string"), F.lit(""))


def _whole(v: Column) -> Column:
    """An integer; 0 for anything else."""
    return F.coalesce(F.when(kind_of(v).isin("bigint", "int"), _get(v, "$", "bigint")), F.lit(0))


def _true(v: Column, default: bool) -> Column:
    """Truth as dynamic languages see it, for booleans, numbers and strings."""
    k = kind_of(v)
    return F.when(v.isNull(), F.lit(default)).when(k == "boolean", _get(v, "$", "boolean")).when(k == "string", _get(v, "$", "string") != "").when(k == "void", F.lit(False)).otherwise(F.coalesce(_get(v, "$", "double") != 0, F.lit(True)))


def to_lore_entries(doc: Column) -> Column:
    """Character-book entries in lore-book layout."""
    return F.transform(entries(doc), lambda e: F.struct(
        F.array_join(as_list(_field(e, "keys", "key")), ", ").alias("key"), _text(e, "content").alias("content"), _text(e, "comment").alias("comment"),
        _true(_field(e, "constant"), False).alias("constant"), _whole(_field(e, "depth")).alias("depth"),
        as_list(_field(e, "secondary_keys", "trigger_words")).alias("trigger_words"), _true(_field(e, "enabled"), True).alias("enabled"),
    ))


def to_character_entries(doc: Column) -> Column:
    """Lore-book entries in character-book layout. A numeric ``constant`` is an old way to write the position."""

    def one(e: Column) -> Column:
        key, const = _field(e, "key"), _field(e, "constant")
        split = F.filter(F.transform(F.split(_get(key, "$", "string"), ","), lambda x: F.trim(x)), lambda x: x != "")
        keys = F.when(kind_of(key) == "array", as_list(key)).otherwise(F.coalesce(split, F.array().cast("array<string>")))
        flag = const.isNull() | (kind_of(const) == "boolean")
        place = F.when(flag, _whole(_field(e, "depth"))).otherwise(_whole(const))
        return F.struct(
            keys.alias("keys"), _text(e, "content").alias("content"), _text(e, "comment").alias("comment"), F.when(flag, _true(const, False)).otherwise(F.lit(False)).alias("constant"), place.alias("depth"),
            F.coalesce(_get(e, "$.insertion_order", "bigint"), 100 - 10 * place).alias("insertion_order"), _true(_field(e, "enabled"), True).alias("enabled"), as_list(_field(e, "trigger_words", "secondary_keys")).alias("secondary_keys"),
        )

    return F.transform(entries(doc), one)


def convert_book(raw: Column, direction: str) -> Column:
    """struct(converted, message): JSON of the converted book, or null and the reason."""
    doc = F.try_parse_json(raw)
    kinds = {"characterbook_to_worldbook": (to_lore_entries, "World"), "worldbook_to_characterbook": (to_character_entries, "Character")}
    if direction not in kinds:
        return F.struct(F.lit(None).cast("string").alias("converted"), F.lit(f"unsupported direction: {direction}").alias("message"))
    make, name = kinds[direction]
    out = F.struct(F.coalesce(_get(doc, "$.name", "string"), F.lit(f"Unnamed {name} Book")).alias("name"), _text(doc, "description").alias("description"), make(doc).alias("entries"))
    some = F.size(entries(doc)) > 0
    return F.struct(F.when(some, F.to_json(out)).alias("converted"), F.when(doc.isNull(), "not valid JSON").when(~some, "no entries found").otherwise("ok").alias("message"))


def _with_default(v: Column, path: str, kind: str, default) -> Column:
    return F.coalesce(_get(v, path, kind), F.lit(default))


def card_defaults(card: Column) -> Column:
    """struct of what a generated card (variant) may lack, with defaults: tags (a text is cut at commas), style, status bar, image."""
    tags = _get(card, "$.tags", "variant")
    cut = F.transform(F.split(_get(tags, "$", "string"), ","), lambda x: F.trim(x))
    listed = F.when(kind_of(tags) == "array", as_list(tags)).when(tags.isNull() | kind_of(tags).isin("void", "null"), F.array().cast("array<string>")).otherwise(cut)
    return F.struct(
        listed.alias("tags"), _with_default(card, "$.custom_css", "string", "").alias("custom_css"), _with_default(card, "$.has_status_bar", "boolean", False).alias("has_status_bar"),
        _with_default(card, "$.status_bar_content", "string", "").alias("status_bar_content"), _with_default(card, "$.image_path", "string", "").alias("image_path"),
    )


def book_defaults(book: Column) -> Column:
    """struct(tags, entries) of a generated book (variant): entries get depth 1, no comment and no trigger words where they have none."""
    one = lambda e: F.struct(e.alias("entry"), _with_default(e, "$.depth", "int", 1).alias("depth"), _with_default(e, "$.comment", "string", "").alias("comment"), as_list(_get(e, "$.trigger_words", "variant")).alias("trigger_words"))
    found = F.coalesce(_get(book, "$.entries", ENTRY), F.array().cast(ENTRY))
    return F.struct(as_list(_get(book, "$.tags", "variant")).alias("tags"), F.transform(found, one).alias("entries"))
