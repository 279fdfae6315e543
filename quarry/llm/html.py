"""Main-text extraction by site style trees.

The pages of one host are merged into a style tree: a node is the path of block elements from the root, each with its
classes; the texts directly in an element are a leaf below it (``#``). Importances are taken from the host's distinct pages (those of
the same texts outside marked elements count once, however many rows):

* a leaf's: the mean, over the occurrences of its texts, of 1 - log(pages with the text) / log(pages); on a host of one page, 1;
* an element's own: entropy of the ways its children are laid out, over log(pages);
* an element's composite one, recursively: (1 - G**(l-1)) of its own + G**(l-1) of the mean of its children's composite ones, weighted by
  the letters they hold, for l layouts. The published method has l for l - 1 and equal weights; so, an element that all pages lay out
  alike says nothing about what it holds, and a short text counts as little as it is.

As in the published method a branch is noise if it and all that is below it have an importance under ``NOISE``; the largest such
branches are cut from each page. Within article and main elements more is asked: ``INSIDE``, with ``DOUBT`` pages added to those counted,
so that two near-copies on a small host don't cut each other's text. A page that would lose all text in this way keeps it.

Entropy can't see noise that is new on each page (a comment, an advert's text), nor any on a host of one page. So elements whose tag or
role says that they are navigation, advertising, a form and so on are marked, and so are those whose class or id does and that don't
hold the page's main text (:meth:`Page._judge`; comments, adverts and boxes of other pages never do, however long). A mark is a prior of the tree: a marked
leaf (``#!``) has ``PRIOR`` times the importance of its texts, inside article elements, too, and is cut by the tree like all other noise.

Text: character references are decoded, white space in a block becomes one space, blocks are joined by one newline.

Edge cases: null or empty html gives the empty text; unclosed and stray tags are forgiven; a null url and one without a host belong to
the host without a name; repeated rows are extracted alike; ids may be null; an empty table gives no rows. Elements deeper than ``NAMED`` share the
node of the deepest one named, so they are kept or cut as one. Other columns are not read.
"""

from __future__ import annotations

import heapq
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.llm.common import schema, written

G, NOISE, INSIDE, DOUBT, PRIOR = 0.9, 0.45, 0.1, 8, 0.3
#: Elements that a path names.
NAMED = 64
#: Pages a task remembers so as not to take an equal one again; beyond it equal ones meet in the shuffle.
KNOWN_PAGES = 100_000
#: Letters of all cut paths together up to which they are broadcast; beyond it a join brings them to the pages.
BROADCAST_LETTERS = 8 << 20

# Element and word lists.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html iframe label legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead tr ul video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HEAD = frozenset("html title base basefont bgsound link meta script style noscript template".split())
CUT = frozenset("nav aside footer form button select dialog menu iframe noscript template svg canvas audio video object textarea option fieldset".split())
CUT_OUTSIDE_ARTICLE = frozenset("header".split())
CUT_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar banner notice notices share sharing social popup modal overlay pagination pager widget toolbar skip".split())
#: What is named so is no main text, whatever its length.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments disqus discussion feedback respond responses reply replies related recommended".split()
)
#: A name that begins or ends so tells of another element.
ABOUT_OTHERS = (frozenset("has have with no not without show hide".split()), frozenset("enabled disabled open opened closed on off".split()))
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: A start tag closes an open element of these kinds at the top of the stack.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}

_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")


def _named(value: str) -> int:
    """What the names in a class or id say: 0 nothing, 1 that the element may be no main text, 2 that it is none."""
    found = 0
    for name in value.split():
        words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if words and words[0] not in ABOUT_OTHERS[0] and words[-1] not in ABOUT_OTHERS[1]:
            found = max(found, 0 if CUT_WORDS.isdisjoint(words) else 1, 0 if NEVER_WORDS.isdisjoint(words) else 2)
    return found


def _style(tag: str, attrs: str, inside: bool) -> tuple[str, bool, int]:
    """(the element's name in paths, whether its tag or role says that it is not main text, what its class or id says)."""
    cut = tag in CUT or (tag in CUT_OUTSIDE_ARTICLE and not inside)
    if "=" not in attrs and "hidden" not in attrs:
        return tag, cut, 0
    classes, marked = "", 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "class":
            classes = ".".join(sorted(re.sub(r"\d+", "", x) for x in value.lower().split()))
        if name in ("class", "id"):
            marked = max(marked, _named(value))
        elif name == "role" and value.lower() in CUT_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            cut = True
    return f"{tag}.{classes}" if classes else tag, cut, marked


class Page:
    """blocks: (path of its leaf, marked by tags or words, text); children: path -> names of what it holds in order, runs as one."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, str]] = []
        self.children: dict[str, list[str]] = {}
        self._text: list[str] = []
        self._stack: list[tuple[str, str, bool, bool, int, bool]] = [("", "", False, False, -1, False)]  # tag, path, cut, inside, mark, main
        self._opened: Counter[str] = Counter()  # how many of each tag the stack holds
        self._outer: list[int] = []  # of each element marked by its words the next marked one around it, -1 for none
        self._never: list[bool] = []  # whether those words leave no doubt
        self._marks: list[tuple[int, bool]] = []  # of each block the innermost marked element, and whether it is main by its element
        at, head, low = 0, False, None
        for m in iter(lambda: _TAG.search(html, at), None):
            text = html[at : m.start()]
            if text and (not head or text.strip()):
                head = False
                self._text.append(text)
            at = max(m.end(), at + 1)
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                head = False if tag == "head" else head
                if tag in BLOCKS:
                    self._close(tag)
                continue
            # The end tag of head and the start tag of body may be left out.
            head = tag == "head" or (head and tag in HEAD)
            if tag in RAW:
                low = html.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
            elif tag in BREAKS:
                self._flush()
            elif tag in BLOCKS:
                self._open(tag, m[3])
        self._text.append(html[at:])
        self._flush()
        if self._outer:
            self._judge()
        self.blocks = [(f"{path}/#!" if cut else f"{path}/#", cut, text) for path, cut, text in self.blocks]

    def _judge(self) -> None:
        """Cuts what elements marked by their words hold. Two kinds of them are not cut, but judged by what they have inside:

        * those with more text of article and main elements than there is outside of all marked elements;
        * where no article or main element has text outside of them, those with over half of the page's text.

        Of nested ones the outer comes first. An article whose own words mark it (a comment, say) is none here. Repeated texts count once.
        Comments, adverts and the like are cut in any case, but on a page that has no text outside of marked elements.
        """
        kept = {m: False for m in range(len(self._outer))}
        weigh: list[list[int]] = [[0, 0] for _ in self._outer]  # of each marked element: letters in all, in main elements
        free, every, seen = [0, 0], 0, set()
        waits: dict[int, list[int]] = {}  # letters by the innermost marked element
        for (_, cut, text), (mark, main) in zip(self.blocks, self._marks):
            if cut or text in seen:
                continue
            seen.add(text)
            every += len(text)
            got = waits.setdefault(mark, [0, 0]) if mark >= 0 else free
            got[0] += len(text)
            got[1] += len(text) * main
        inner: dict[int, list[int]] = {}
        for m in range(len(self._outer) - 1, -1, -1):  # an element comes after those around it
            own = waits.get(m, [0, 0])
            weigh[m][0] += own[0]
            weigh[m][1] += own[1]
            if self._outer[m] >= 0:
                weigh[self._outer[m]][0] += weigh[m][0]
                weigh[self._outer[m]][1] += weigh[m][1]
            inner.setdefault(self._outer[m], []).append(m)
        never = self._never if free[0] else [False] * len(self._never)
        for kind in (1, 0):
            if kind == 0 and free[1]:
                break
            heap = [(-weigh[m][kind], m) for m in range(len(self._outer)) if not kept[m] and not never[m] and (self._outer[m] < 0 or kept[self._outer[m]])]
            heapq.heapify(heap)
            while heap and -heap[0][0] > (free[1] if kind else every / 2):
                m = heapq.heappop(heap)[1]
                kept[m] = True
                own = waits.get(m, [0, 0])
                free[0] += own[0]
                free[1] += own[1]
                for x in inner.get(m, ()):
                    if not never[x]:
                        heapq.heappush(heap, (-weigh[x][kind], x))
        gone = []  # whether an element or one around it is cut
        for m, outer in enumerate(self._outer):
            gone.append(not kept[m] or (outer >= 0 and gone[outer]))
        self.blocks = [(path, cut or (mark >= 0 and gone[mark]), text) for (path, cut, text), (mark, _) in zip(self.blocks, self._marks)]

    def _flush(self) -> None:
        if self._text:
            _, path, cut, _, mark, main = self._stack[-1]
            text = " ".join(_html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((path, cut, text))
                self._marks.append((mark, main))
                self._laid_out(path, "#")
            self._text.clear()

    def _laid_out(self, path: str, name: str) -> None:
        got = self.children.setdefault(path, [])
        if not got or got[-1] != name:
            got.append(name)

    def _open(self, tag: str, attrs: str) -> None:
        self._flush()
        ends = CLOSES.get(tag, ())
        while len(self._stack) > 1 and (self._stack[-1][0] == "p" or self._stack[-1][0] in ends):
            self._opened[self._stack.pop()[0]] -= 1
        if tag in ("html", "body") and self._opened[tag]:
            return
        _, path, cut, inside, mark, main = self._stack[-1]
        name, own, marked = _style(tag, attrs, inside)
        self._laid_out(path, name)
        inside = inside or tag in ("article", "main")
        if tag in ("article", "main") and marked < 2:
            main = main or not marked
        elif marked and tag not in ("html", "body"):
            self._outer.append(mark)
            self._never.append(marked == 2)
            mark = len(self._outer) - 1
        # Deeper elements count as part of the deepest one named.
        self._stack.append((tag, f"{path}/{name}" if len(self._stack) < NAMED else path, cut or own, inside, mark, main))
        self._opened[tag] += 1

    def _close(self, tag: str) -> None:
        if self._opened[tag]:
            self._flush()
            closed = ""
            while closed != tag:
                closed = self._stack.pop()[0]
                self._opened[closed] -= 1


def host_of(url: Column) -> Column:
    """The url's host in small letters; empty where it has none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def prefixes(path: str) -> list[str]:
    """The branches a path is in: of /a/b they are /a and /a/b."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def main_text(html: str | None, cut: frozenset[str] | set[str] | None = None) -> str:
    """The page's text without the branches of ``cut`` (paths); of a page by itself (None) without what is marked."""
    if not html:
        return ""
    blocks = Page(html).blocks
    unmarked = [b for b in blocks if not b[1]]
    if cut is None:
        blocks = unmarked
    elif cut:
        known = {p: not cut.isdisjoint(prefixes(p)) for p in {b[0] for b in blocks}}
        blocks = [b for b in blocks if not known[b[0]]] or unmarked
    return "\n".join(b[2] for b in blocks)


STATS = "host string, page long, nodes array<struct<path:string,hash:long,letters:long>>"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page the hash of its texts, and of its distinct texts by leaf and the layout of each element the hash (letters: 0 for a layout)."""
    h = lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - 2**63
    kind = pa.list_(pa.struct([("path", pa.string()), ("hash", pa.int64()), ("letters", pa.int64())]))
    done: set[tuple[str, int]] = set()
    for b in batches:
        hosts, keys, nodes = [], [], []
        for host, html in zip(b.column(0).to_pylist(), b.column(1)):
            html = html.as_py()
            if not html or (same := (host, h(html))) in done:
                continue
            if len(done) < KNOWN_PAGES:
                done.add(same)
            page = Page(html)
            rows = {(p, h(t), len(t)) for p, _, t in page.blocks} | {(p, h("\0".join(c)), 0) for p, c in page.children.items()}
            hosts.append(host)
            keys.append(h("\0".join(t for _, marked, t in page.blocks if not marked)))
            nodes.append([{"path": p, "hash": x, "letters": k} for p, x, k in sorted(rows)])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(nodes, kind)], ["host", "page", "nodes"])


def _branches(path: str = "path", least: int = 2) -> Column:
    """:func:`prefixes` of a path column; with ``least`` 1 the root, the empty path, is one too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(least), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, letters, importance) of each node of each host's tree; a leaf's path ends with /# or, if it is marked, with /#!.

    Nodes with little text are small rows, however long the texts; what is joined is one row for each node and one above it.
    """
    seen = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_stats, STATS)
    # Of pages with the same texts in other markup, the least markup stands for all.
    seen = seen.groupBy("host", "page").agg(F.min("nodes").alias("nodes")).select("host", F.inline("nodes"))
    values = written(seen.groupBy("host", "path", "hash", "letters").agg(F.count("*").alias("n")))
    size = values.where("letters = 0 and path = ''").groupBy("host").agg(F.sum("n").alias("pages"))
    log_pages = F.log("pages")
    doubt = F.when(F.col("path").rlike("/(article|main)\\b"), DOUBT).otherwise(0)
    # The number of pages joins one row for each node, not one for each text.
    each = lambda rows, *more: rows.groupBy("host", "path").agg(*more, F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("n_log_n")).join(size, "host")
    texts = each(values.where("letters > 0"), F.sum(F.col("n") * F.col("letters")).alias("letters"))
    prior = F.when(F.col("path").endswith("!"), PRIOR).otherwise(1.0)
    content = prior * F.when(F.col("pages") == 1, 1.0).otherwise(1 - F.col("n_log_n") / F.col("n") / F.log(F.col("pages") + doubt))
    leaves = texts.select("host", "path", "letters", content.alias("own"), F.lit(0.0).alias("g"))
    layouts = each(values.where("letters = 0"), F.count("*").alias("l"))
    entropy = F.when(F.col("pages") > 1, (F.log("n") - F.col("n_log_n") / F.col("n")) / log_pages).otherwise(1.0)
    g = (F.col("l") - 1) * F.log(F.lit(G))
    held = leaves.select("host", F.explode(_branches(least=1)).alias("path"), "letters", F.col("path").alias("leaf")).where("path <> leaf").groupBy("host", "path").agg(F.sum("letters").alias("letters"))
    elements = layouts.select("host", "path", ((1 - F.exp(g)) * entropy).alias("own"), g.alias("g")).join(held, ["host", "path"])
    nodes = written(leaves.unionByName(elements))
    # What a node adds to one above it: its share of the letters, and the weights G**(l-1) of all elements from that one down to it.
    up = nodes.select("host", "path", F.explode(_branches(least=1)).alias("above"))
    weigh = up.where("above <> path").join(nodes.select("host", F.col("path").alias("above"), "g"), ["host", "above"]).groupBy("host", "path").agg(F.sum("g").alias("way"))
    nodes = written(nodes.join(weigh, ["host", "path"], "left").withColumn("way", F.coalesce("way", F.lit(0.0))))
    pairs = nodes.select("host", F.explode(_branches(least=1)).alias("above"), (F.col("letters") * F.col("own")).alias("gives"), "way")
    tops = nodes.select("host", F.col("path").alias("above"), F.col("letters").alias("all"), F.col("way").alias("way_above"))
    sums = pairs.join(tops, ["host", "above"]).groupBy("host", "above").agg((F.sum(F.col("gives") * F.exp(F.col("way") - F.col("way_above"))) / F.first("all")).alias("importance"), F.first("all").alias("letters"))
    return sums.select("host", F.col("above").alias("path"), "letters", "importance")


def cut_branches(tree: DataFrame) -> DataFrame:
    """(host, cut array<string>): the largest branches of noise. A host has as many as its templates have elements."""
    low = F.when(F.col("path").rlike("/(article|main)\\b") & ~F.col("path").endswith("/#!"), INSIDE).otherwise(NOISE)
    nodes = tree.where("path <> ''").select("host", "path", (F.col("importance") < low).alias("low"))
    good = nodes.where("not low").select("host", F.explode(_branches()).alias("path")).distinct()
    noise = nodes.where("low").join(good, ["host", "path"], "left_anti")
    inner = noise.select("host", F.col("path").alias("outer"))
    largest = noise.withColumn("outer", F.regexp_replace("path", "/[^/]*$", "")).join(inner, ["host", "outer"], "left_anti")
    return largest.groupBy("host").agg(F.collect_list("path").alias("cut"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of each page."""
    cuts = written(cut_branches(style_tree(pages, url_col, html_col)))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if (cuts.agg(F.sum(F.length("host") + F.aggregate("cut", F.lit(0), lambda s, x: s + F.length(x) + 8))).first()[0] or 0) <= BROADCAST_LETTERS:
        # The map goes to the tasks once; they look the host up themselves.
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["cut"]) for r in cuts.collect()})
        rows = rows.withColumn("cut", F.lit(None).cast("array<string>"))
    else:
        known = None
        rows = rows.join(cuts, "host", "left").select("id", "url", "html", "host", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [known.value.get(h, frozenset()) for h in b.column(3).to_pylist()] if known else [set(c or ()) for c in b.column(4).to_pylist()]
            texts = [main_text(h.as_py(), c) for h, c in zip(b.column(2), cut)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.mapInArrow(run, schema(id=rows.schema["id"].dataType, url=StringType(), text=StringType()))
