"""Document tree: pages from front matter, links, hierarchy with synthesised parents, index pages, flattening."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.markdown import LINK, first_heading, front_matter
from quarry.functions.text import content_hash, digits_or_null
from quarry.operators.ingest import numbered as numbered_by

# What marks probe pages; the title of the root.
PROBE, JUNK_ROUTE, JUNK_TITLE = r"(?i)^#\s*Index Probe", r"(?i)^/(verify|test|tmp)(/|$)", r"(?i)删除探测|deletion[- ]?probe"
ROOT_TITLE = "文档"


def segments(route: Column) -> Column:
    return F.filter(F.split(route, "/"), lambda x: x != "")


def normal_route(route: Column) -> Column:
    """One slash at both ends."""
    return F.when(F.size(segments(route)) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(segments(route), "/"), F.lit("/")))


def route_path(route: Column) -> Column:
    """The file of a route, relative to the output folder."""
    return F.when(F.size(segments(route)) == 0, "index.md").otherwise(F.concat(F.array_join(segments(route), "/"), F.lit(".md")))


def depth(route: Column) -> Column:
    return F.size(segments(route))


def pages(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, route, title, icon, ord, body, source_rel, skip_reason) of raw (text); sources: (key = md5 of the text, source_rel).

    The first rule that fits names the reason; kept pages have none.
    """
    rows = raw.select(content_hash(F.col("text")).alias("key"), F.col("text").alias("raw"), front_matter(F.col("text")).alias("f")).select("key", "raw", "f.meta", "f.body")
    rows = rows.join(sources.groupBy("key").agg(F.min("source_rel").alias("source_rel")), "key", "left")
    meta = lambda k: F.nullif(F.try_element_at("meta", F.lit(k)), F.lit(""))
    probe = F.col("raw").rlike(PROBE)
    reason = (
        F.when(probe, "probe").when(meta("redirect").isNotNull(), "redirect").when(F.lower(meta("visibility")) == "hidden", "hidden").when(meta("route").isNull(), "no_route")
        .when(meta("route").rlike(JUNK_ROUTE) | F.substring("raw", 1, 600).rlike(JUNK_TITLE), "probe").when(~F.col("body").rlike(r"(?U)\S"), "empty").when(F.col("source_rel").isNull(), "no_source")
    )
    title = F.coalesce(meta("title"), meta("label"), first_heading(F.col("body")), meta("route"))
    return rows.select("key", meta("route").alias("route"), title.alias("title"), F.coalesce(meta("icon"), F.lit("")).alias("icon"), digits_or_null(meta("order")).alias("ord"), "body", "source_rel", reason.alias("skip_reason"))


def skip_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def tree(found: DataFrame) -> DataFrame:
    """(route, parent, depth, title, icon, ord, synthetic): pages and every ancestor they lack. found: (route, title[, icon, ord])."""
    cols = found.columns
    own = found.select(normal_route(F.col("route")).alias("route"), F.col("title"), (F.col("icon") if "icon" in cols else F.lit("")).alias("icon"), (F.col("ord") if "ord" in cols else F.lit(None).cast("int")).alias("ord"))
    own = own.groupBy("route").agg(F.min(F.struct("title", "icon", "ord")).alias("p"))
    steps = own.select(segments(F.col("route")).alias("s")).where(F.size("s") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("s", 1, i), "/"), F.lit("/")))).alias("route"))
    root = found.sparkSession.range(1).select(F.lit("/").alias("route"))
    every = steps.union(root).distinct().join(own, "route", "left")
    s = segments(F.col("route"))
    parent = F.when(F.size(s) == 0, F.lit(None)).when(F.size(s) == 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(s, F.lit(1), F.size(s) - 1), "/"), F.lit("/")))
    title = F.coalesce("p.title", F.when(F.col("route") == "/", ROOT_TITLE).otherwise(F.element_at(s, -1)))
    return every.select("route", parent.alias("parent"), F.size(s).alias("depth"), title.alias("title"), F.coalesce("p.icon", F.lit("")).alias("icon"), F.col("p.ord").alias("ord"), F.col("p").isNull().alias("synthetic"))


def sort_key() -> Column:
    """Nodes with an order first, by it; then by title."""
    return F.struct(F.col("ord").isNull().cast("int").alias("late"), F.coalesce("ord", F.lit(0)).alias("at"), F.coalesce("title", "route").alias("name"), F.col("route").alias("r"))


def _ancestors(route: Column) -> Column:
    """A route and all routes above it, from the root down."""
    s = segments(route)
    return F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.when(i == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(s, F.lit(1), i), "/"), F.lit("/"))))


def flatten(nodes: DataFrame) -> DataFrame:
    """nodes with ``path_key``, whose order is depth first: the sort keys of all ancestors. One join on the ancestors' routes."""
    keys = nodes.select(F.col("route").alias("_a"), sort_key().alias("_k"))
    up = nodes.select("route", F.posexplode(_ancestors(F.col("route"))).alias("_d", "_a"))
    chain = up.join(keys, "_a").groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_k"))), lambda x: x["_k"]).alias("path_key"))
    return nodes.join(chain, "route")


def index_pages(nodes: DataFrame) -> DataFrame:
    """(route, body) of synthetic nodes: a list of their children in tree order."""
    kids = nodes.select(F.col("parent").alias("route"), sort_key().alias("k"), F.concat(F.lit("- ["), "title", F.lit("]("), "route", F.lit(")"), F.when(F.col("synthetic"), "（小节）").otherwise("")).alias("line"))
    lists = kids.where("route is not null").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("c"))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n本节共 "), F.size("c").cast("string"), F.lit(" 个页面：\n\n"), F.array_join(F.transform("c", lambda x: x["line"]), "\n"), F.lit("\n"))
    return nodes.where("synthetic").join(lists, "route").select("route", text.alias("body"))


def links(bodies: DataFrame) -> DataFrame:
    """(source_rel, ord, text, target, anchor) of links that point within the site: not images, not other schemes, not bare anchors."""
    found = F.posexplode(F.regexp_extract_all("body", F.lit(LINK), 0)).alias("ord", "link")
    rows = bodies.select("source_rel", found)
    bang, text, full = (F.regexp_extract("link", LINK, i) for i in (1, 2, 3))
    rows = rows.select("source_rel", "ord", bang.alias("bang"), text.alias("text"), full.alias("full"))
    rows = rows.where((F.col("bang") == "") & ~F.col("full").rlike("^[a-z][a-z0-9+.-]*:|^#"))
    return rows.select("source_rel", "ord", "text", F.substring_index("full", "#", 1).alias("target"), F.regexp_extract("full", "(#.*)$", 1).alias("anchor"), "full")


def resolve(found: DataFrame, routes: DataFrame) -> DataFrame:
    """links with ``route`` (null if unknown). routes: (source_rel, route).

    Every way to read a target is one candidate with a priority; all are looked up in one equi-join and the best kept, so the
    table of routes may be of any size.
    """
    base = F.when(F.col("target").startswith("/"), F.array()).otherwise(F.slice(F.split("source_rel", "/"), F.lit(1), F.size(F.split("source_rel", "/")) - 1))
    parts = F.concat(base.cast("array<string>"), F.split("target", "/"))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    md = F.lower("target").endswith(".md")
    paths = F.when(md, F.array(path)).otherwise(F.array(F.concat(path, F.lit(".md")), F.concat_ws("/", F.nullif(path, F.lit("")), F.lit("index.md"))))
    tried = found.withColumn("_p", F.concat(F.transform(paths, lambda p, i: F.struct(F.lit("f").alias("kind"), F.lower(p).alias("k"), p.alias("exact"), i.alias("pri"))), F.when(~md & F.col("target").startswith("/"), F.array(F.struct(F.lit("r").alias("kind"), normal_route(F.col("target")).alias("k"), F.lit("").alias("exact"), F.lit(9).alias("pri")))).otherwise(F.array().cast("array<struct<kind:string,k:string,exact:string,pri:int>>"))))
    tried = tried.select("source_rel", "ord", F.explode("_p").alias("p")).select("source_rel", "ord", "p.*")
    known = routes.select(F.lit("f").alias("kind"), F.lower("source_rel").alias("k"), F.col("source_rel").alias("_is"), "route").union(routes.select(F.lit("r"), normal_route(F.col("route")), F.lit(""), "route"))
    best = tried.join(known, ["kind", "k"]).groupBy("source_rel", "ord").agg(F.min_by("route", F.struct("pri", F.col("exact") != F.col("_is"), "_is", "route")).alias("route"))
    return found.join(best, ["source_rel", "ord"], "left")


def rewrite(bodies: DataFrame, resolved: DataFrame, demote: bool = True, assets: DataFrame | None = None) -> DataFrame:
    """bodies (source_rel, body) with links to routes; unknown ones become their text if ``demote``. Images stay as they are.

    Each page's replacements travel with it (a page's links bound them); a small pandas UDF applies them.
    """
    keep = resolved
    if assets is not None:
        keep = keep.join(assets.select(F.col("path").alias("target"), F.lit(True).alias("_asset")).distinct(), "target", "left").where("_asset is null")
    per = keep.where(F.col("route").isNotNull() | F.lit(demote)).groupBy("source_rel").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("full", F.coalesce(F.concat("route", "anchor"), F.lit("")).alias("to"))))).alias("to"))

    @F.pandas_udf("string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import re

        link = re.compile(LINK)
        for bodies, maps in batches:
            out = []
            for body, to in zip(bodies, maps):
                known = dict(to) if to is not None else {}
                new = lambda m, known=known: m[0] if m[1] or m[3] not in known else f"[{m[2]}]({known[m[3]]})" if known[m[3]] else m[2]
                out.append(link.sub(new, body) if body is not None else None)
            yield pd.Series(out)

    return bodies.join(per, "source_rel", "left").withColumn("body", apply("body", "to")).drop("to")


def consistency(listed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, problem) of paths that one side alone has."""
    return listed.join(on_disk, "path", "left_anti").select("path", F.lit("missing").alias("problem")).union(on_disk.join(listed, "path", "left_anti").select("path", F.lit("unlisted")))


def article(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (route, with or without outer slashes) joined to its node; top_level says depth at most 1, null where there is no such page."""
    asked = wanted.select(F.col("route").alias("asked"), normal_route(F.col("route")).alias("route"))
    known = nodes.withColumn("top_level", depth(F.col("route")) <= 1)
    return asked.join(known, "route", "left")


def staleness(manifest: DataFrame, fingerprint: DataFrame, commit: str, force: bool = False) -> DataFrame:
    """(status) of generated pages: ``current`` if the last manifest row (fingerprint, commit) has both as they are now, else ``stale``."""
    same = manifest.join(fingerprint, "fingerprint").where(F.col("commit") == commit).agg(F.count("*").alias("n"))
    return same.select(F.when((F.col("n") > 0) & F.lit(not force), "current").otherwise("stale").alias("status"))


def intervals(nodes: DataFrame) -> DataFrame:
    """nodes with ``enter`` and ``leave``, long: a node's subtree are the nodes with ``enter`` in [its enter, its leave], depth first in tree order.

    Places are running numbers over ranges of the sort keys; sizes of subtrees are counts by ancestor, made before they are shuffled.
    """
    ordered = numbered_by(flatten(nodes), ["path_key", "route"], "enter").drop("path_key")
    sizes = nodes.select(F.explode(_ancestors(F.col("route"))).alias("route")).groupBy("route").agg(F.count("*").alias("_n"))
    return ordered.join(sizes, "route").withColumn("leave", F.col("enter") + F.col("_n") - 1).select(*nodes.columns, "enter", "leave")


def subtree(placed: DataFrame, route: str) -> DataFrame:
    """The nodes below a route, itself included, of :func:`intervals`: one row is looked up, then a range is read."""
    found = placed.where(F.col("route") == normal_route(F.lit(route))).select("enter", "leave").first()
    return placed.where(F.col("enter").between(found["enter"], found["leave"]) if found else F.lit(False))


def nested_parts(placed: DataFrame) -> DataFrame:
    """(enter, route, part) of :func:`intervals`: each node's piece of the nested JSON. Joined by enter they are the whole text; a subtree's pieces,
    but for the first one's comma and the closings beyond it, are the subtree's."""
    first = placed.select(F.col("route").alias("parent"), F.col("enter").alias("_of"))
    closed = placed.groupBy(F.col("leave").alias("enter")).agg(F.count("*").cast("int").alias("_ends"))
    own = F.to_json(F.struct("route", "title", "synthetic"))
    comma = F.when(F.col("enter") > F.coalesce(F.col("_of") + 1, F.col("enter")), ",").otherwise("")
    part = F.concat(comma, F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['), F.expr("repeat(']}', coalesce(_ends, 0))"))
    return placed.join(first, "parent", "left").join(closed, "enter", "left").select("enter", "route", part.alias("part"))


def children_lists(nodes: DataFrame) -> DataFrame:
    """(route, children array<struct<route,title,synthetic>> in tree order): the nested form is folded from these by depth."""
    w = F.array_sort(F.collect_list(F.struct(sort_key().alias("k"), F.struct("route", "title", "synthetic").alias("c"))))
    return nodes.where("parent is not null").groupBy(F.col("parent").alias("route")).agg(F.transform(w, lambda x: x["c"]).alias("children"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Children of each node numbered in tree order."""
    return nodes.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy(sort_key())))
