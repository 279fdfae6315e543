"""Rules for markdown: substitutions by one pattern each, and chunks by a walk over offsets. pandas UDFs apply both in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Icons of admonition kinds, the word for a note without a title.
ICONS = {
    "note": "📝", "info": "ℹ️", "tip": "💡", "hint": "💡", "important": "❗", "warning": "⚠️", "caution": "⚠️", "danger": "🚫", "error": "⛔",
    "bug": "🐞", "example": "🧪", "quote": "❝", "abstract": "📌", "success": "✅", "question": "❓", "failure": "❌", "attention": "⚠️",
}
OTHER_ICON, NOTE_TITLE = "📌", "提示"

#: A link's target: no white space, and brackets only in pairs. A link or image as (bang, text, target); an image alone.
_TARGET = r"(?:[^\s()]++|\([^\s()]*\))*"
LINK = rf"(!?)\[([^\[\]]+)\]\(({_TARGET})\)"
IMAGE = rf"!\[[^\]]*\]\({_TARGET}\)"

# Pieces of patterns: white space within a line, the end of a line, a line that closes a block, one that stands for its own.
_S, _EOL = r"[^\S\n]*", r"(?=\n|\Z)"
_SHUT = rf"{_S}(?:!!!|:::){_S}{_EOL}"
_DEEP = r"(?:\ {4}|\t)[^\n]*"
_ADMONITION = re.compile(
    rf"""^{_S}(?:!!!|\?\?\?\+?)
    (?!{_S}(?:"{_S}")?{_S}{_EOL})                            # some kind or title follows
    {_S}(?P<kind>[A-Za-z][\w-]*)? (?:[^\S\n]+"(?P<quoted>[^"\n]*)")? (?:[^\S\n]+(?P<plain>\S[^\n]*?))? {_S}{_EOL}
    (?: \n(?P<deep>(?!{_SHUT}){_DEEP} (?:\n(?!{_SHUT})(?:{_DEEP}|{_S}{_EOL}))*)
      | (?P<flat>(?:\n(?!{_SHUT})(?!{_S}(?:\Z|\n{_S}(?:{_EOL}|\#{{1,6}}\s|```|~~~|!!!|:::{_S}{_EOL}|\?\?\?)))[^\n]*)*)
    )
    (?:\n(?:{_SHUT}|(?(deep)(?!)|{_S}{_EOL})))?               # the line that closes it goes too""",
    re.M | re.X,
)
_STRAY = re.compile(rf"^{_SHUT}", re.M)
_FENCE = rf"{_S}:::+{_S}(?P<kind>[\w-]*){_S}{_EOL}"
_CONTAINER = re.compile(rf"^{_FENCE}(?P<body>(?:\n(?!{_FENCE.replace('?P<kind>', '?:')})[^\n]*)*)(?P<end>\n{_FENCE.replace('?P<kind>', '?:')})?", re.M)
_TAB = re.compile(rf'^{_S}===[^\S\n]+"([^"\n]+)"{_S}$', re.M)


def _quote(text: str) -> list[str]:
    return [f"> {line}".rstrip() for line in text.split("\n")]


def _titled(kind: str, title: str) -> list[str]:
    return [f"> **{ICONS.get(kind.lower(), OTHER_ICON)} {title}**", ">"]


def admonitions(body: str) -> str:
    """Admonition blocks, indented or flat, become quotes with an icon and a title; stray markers become an empty note."""

    def quoted(m: re.Match) -> str:
        kind = m["kind"] or "note"
        inside = re.sub(r"(?m)^(?: {4}|\t)", "", m["deep"]) if m["deep"] else re.sub(r"(?m)^\t", "", (m["flat"] or "")[1:])
        inside = re.sub(r"(?m)^[^\S\n]+$", "", inside).rstrip("\n")
        return "\n".join([*_titled(kind, (m["quoted"] or m["plain"] or "").strip() or kind.capitalize()), *(_quote(inside) if inside else []), ""])

    return _STRAY.sub(f"> **{ICONS['note']} {NOTE_TITLE}**", _ADMONITION.sub(quoted, body))


def containers(body: str) -> str:
    """``:::kind`` to ``:::`` becomes a quote, with a title unless it is a plain callout."""

    def quoted(m: re.Match) -> str:
        head = [] if m["kind"].lower() in ("", "callout") else _titled(m["kind"], m["kind"].capitalize())
        return "\n".join([*head, *(_quote(m["body"][1:]) if m["body"] else []), *([""] if m["end"] else [])])

    return _CONTAINER.sub(quoted, body)


def tabs(body: str) -> str:
    """Tab markers become bold headings; what follows the first one loses four spaces."""
    first = _TAB.search(body)
    if not first:
        return body
    rest = re.sub(r"(?m)^ {4}", "", body[first.end() :])
    return f"{body[: first.start()]}**{first[1]}**\n" + _TAB.sub(lambda m: f"\n**{m[1]}**\n", rest)


def _mapped(rule: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(rule, na_action="ignore")

    return run


def convert_admonitions(body: Column) -> Column:
    return _mapped(admonitions)(body)


def convert_containers(body: Column) -> Column:
    return _mapped(containers)(body)


def convert_tabs(body: Column) -> Column:
    return _mapped(tabs)(body)


def web_markdown(body: Column) -> Column:
    """All three, in one pass over Python."""
    return _mapped(lambda t: tabs(containers(admonitions(t))))(body)


_HEADING = re.compile(r"\n(?=#{1,3}[^\S\n])")
_GAP = re.compile(r"\n\s*\n")
_INK = re.compile(r"\S")


def _runs(n: int, full: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """[from, to) of runs of n pieces: piece i begins a new run where ``full(from, i)``."""
    first = 0
    for i in range(1, n):
        if full(first, i):
            yield first, i
            first = i
    if n:
        yield first, n


def chunk_pieces(body: str, longest: int, packed: int, least_head: int, least: int) -> list[str]:
    """The pieces of one text. Sections and paragraphs are walked by their offsets, each character a bounded number of times."""
    starts = [0, *(m.end() for m in _HEADING.finditer(body)), len(body) + 1]
    breaks = [i for i, c in enumerate(body) if c == "\n"]

    def letters(a: int, b: int) -> int:
        """Characters of body[a:b] but for line breaks and the white space at both ends."""
        first = _INK.search(body, a, b)
        if not first:
            return 0
        while body[b - 1].isspace():
            b -= 1
        return b - first.start() - (bisect_left(breaks, b) - bisect_left(breaks, first.start()))

    out = []
    for i, j in _runs(len(starts) - 1, lambda i, j: letters(starts[i], starts[j] - 1) >= least_head):
        a, b = starts[i], starts[j] - 1
        if b == len(body) and letters(a, b) < least:
            continue
        if b - a <= longest:
            out.append(body[a:b].strip())
            continue
        parts = _GAP.split(body[a:b])
        ends = [0, *accumulate(len(p) + 2 for p in parts)]  # with the blank line that joins it to the next
        packs = _runs(len(parts), lambda i, j: ends[j + 1] - ends[i] - 4 > packed)  # noqa: B023
        out += [x for x in ("\n\n".join(parts[i:j]).strip() for i, j in packs) if len(x) >= least]
    return out


def chunk_texts(body: Column, longest: int = 2000, packed: int = 1800, least_head: int = 50, least: int = 20) -> Column:
    """array<string>: pieces at headings of level 1 to 3 once a piece is long enough; long pieces are packed by paragraph, a long
    paragraph staying whole. A short last piece goes. Null is the empty text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.fillna("").map(lambda t: chunk_pieces(t, longest, packed, least_head, least))

    return run(body)


def front_matter(raw: Column) -> Column:
    """struct(meta map<string,string>, body): the header between --- lines; quotes are stripped, a later key wins."""
    head = F.regexp_extract(raw, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    body = F.regexp_replace(raw, r"(?s)\A\x{FEFF}?---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^#:][^:]*:"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']|[\"']$", "").alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.struct(F.map_from_entries(last).alias("meta"), body.alias("body"))


def first_heading(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))


def image_count(body: Column) -> Column:
    return F.size(F.regexp_extract_all(body, F.lit(IMAGE), 0))
