"""Hybrid retrieval: lexical and vector candidates, content dedup, rerank, neighbours, budgeted context.

The lexical leg is a stored index (:mod:`quarry.operators.lexical`), the vector leg an exact scan or an inverted file
(:mod:`quarry.operators.vectors`). Texts are met again by the few rows that a search returns. One query is a driver-side value (words
and one vector); the batched searches of the two indexes take tables of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.functions.text import content_hash
from quarry.operators.lexical import Index, bm25_top, texts_of
from quarry.operators.ranking import context_budget
from quarry.sources import scratch

#: Most results, budget of a prompt, texts in one call of a reranker.
MOST_RESULTS, CONTEXT_CHARS, RERANK_BATCH = 40, 8000, 40


def cosine(vec: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed vector, in double precision; 0 where there is no vector or it is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(vec, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.when(norm * length > 0, dot / (norm * length)), F.lit(0.0))


def vector_top(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, sim): exact top-k by cosine, ties to the smaller id; one scan and a bounded heap a task."""
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), query).alias("sim")).orderBy(F.desc("sim"), "id").limit(k)


def candidates(ix: Index, vectors: DataFrame, query_terms: Sequence[str], query_vec: Sequence[float], pool: int, top_k: int, id_col: str = "vec_id", vec_col: str = "embedding", nearest: Callable[[Sequence[float], int], DataFrame] | None = None) -> DataFrame:
    """(id, text, sim, leg, ord, h): the vector leg, then the lexical leg's new texts (sim 0), first of equal texts kept.

    ``nearest`` (query, k) -> (id, sim) stands in for the exact scan of ``vectors``, as the search of an inverted file does.

    Both legs are bounded (``max(pool, top_k)`` and 40 rows), so what follows them is small; texts are read for them alone, by their ids.
    """
    found = nearest(query_vec, max(pool, top_k)) if nearest else vector_top(vectors, query_vec, max(pool, top_k), id_col, vec_col)
    lead = found.select("id", F.round("sim", 4).alias("sim"), F.lit(0).alias("leg"), F.col("sim").alias("by"))
    lexical = bm25_top(ix, query_terms).select("id", F.lit(0.0).alias("sim"), F.lit(1).alias("leg"), F.col("score").alias("by"))
    hits = scratch.stored(lead.unionByName(lexical))
    both = texts_of(ix, hits).join(F.broadcast(hits), "id").withColumn("h", content_hash(F.col("text")))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("by"), "id")))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("h").orderBy("leg", "rank"))).where("_n = 1")
    return first.select("id", "text", "sim", "leg", F.row_number().over(Window.orderBy("leg", "rank")).alias("ord"), "h")


def search(found: DataFrame, top_n: int, scorer: Column | None = None, logit: bool = True, chars: int = 500) -> DataFrame:
    """(ord, id, content, score) of the results of :func:`candidates`, by the three-way contract.

    At most ``top_n`` candidates: all, in their own order, with similarities. No scorer: the best by similarity. Else the best by
    the scorer's value, shown as its sigmoid if it is a logit. The scorer is any column over (id, text), such as a pandas UDF.
    """
    top_n = max(1, min(MOST_RESULTS, top_n))
    few = F.count("*").over(Window.partitionBy()) <= top_n
    by = F.col("sim") if scorer is None else scorer
    shown = by if scorer is None or not logit else 1 / (1 + F.exp(-by))
    rows = found.withColumn("_by", by.cast("double")).withColumn("_few", few).withColumn("_shown", F.when(F.col("_few"), F.col("sim")).otherwise(shown if scorer is None else F.coalesce(shown, F.lit(0.5 if logit else 0.0))))
    order = [F.when(F.col("_few"), F.lit(0.0)).otherwise(-F.coalesce(F.col("_by"), F.lit(0.0))), F.col("ord")]
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= top_n)
    return rows.select(F.col("place").alias("ord"), "id", F.substring("text", 1, chars).alias("content"), F.round("_shown", 4).alias("score"))


def rerank(found: DataFrame, model: Callable[[dict], dict], size: int = RERANK_BATCH) -> DataFrame:
    """found (with ord) and ``rerank``, double: the model is given ``size`` texts by id at a time and returns scores by id, in any order; one it leaves out is 0."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        scores = model(dict(zip(rows["id"], rows["text"])))
        return rows.drop(columns="_batch").assign(rerank=[float(scores.get(i) or 0.0) for i in rows["id"]])

    kind = StructType([*found.schema.fields, StructField("rerank", DoubleType())])
    return found.withColumn("_batch", F.floor((F.col("ord") - 1) / size)).groupBy("_batch").applyInPandas(score, kind)


def rerank_input(text: Column, chars: int = 1500) -> Column:
    """What a local rerank model is given of a text: models read so many characters at most. Scorers without that bound take whole texts."""
    return F.substring(text, 1, chars)


def with_metadata(hits: DataFrame, metas: DataFrame) -> DataFrame:
    """hits (with h, the text's hash) and source, module, language, source_file by hash, with defaults for texts that have none.

    metas: (h, ord, source, module, language, source_file); of equal texts the last by ``ord`` counts.
    """
    fields = ["source", "module", "language", "source_file"]
    last = metas.groupBy("h").agg(F.max_by(F.struct(*fields), F.struct("ord", *fields)).alias("_m"))
    out = hits.join(last, "h", "left")
    file = F.coalesce("_m.source_file", F.lit(""))
    missing = lambda shown: F.when(F.col("_m").isNull(), shown)
    return out.select(
        *hits.columns, missing("bm25_match").otherwise(F.coalesce("_m.source", F.lit("unknown"))).alias("source"), F.coalesce("_m.module", file).alias("module"),
        missing("zh").otherwise(F.coalesce("_m.language", F.lit("unknown"))).alias("language"), file.alias("source_file"),
    )


def with_neighbours(found: DataFrame, context: DataFrame) -> DataFrame:
    """(id, text, ord) of results (ord) and then of their neighbours (ctx) whose text isn't among what comes before them."""
    rows = found.select("id", "text", F.lit(0).alias("leg"), F.col("ord").alias("at")).union(context.select("id", "text", F.lit(1), F.col("ctx")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(content_hash(F.col("text"))).orderBy("leg", "at", "id")))
    # Results are shown as they are, repeats too; both lists are bounded by the search.
    kept = rows.where((F.col("leg") == 0) | (F.col("_n") == 1))
    return kept.select("id", "text", F.row_number().over(Window.orderBy("leg", "at", "id")).alias("ord"))


def routed(hits: DataFrame, routes: DataFrame) -> DataFrame:
    """hits (source_file, module) with route and title, by the file's name or, where that is unknown, the module's; null where both are.

    routes: (source_rel, route, title), one row a page; a missing title is the route. Hits are bounded by the search and broadcast.
    """
    names = hits.select("ord", F.explode(F.array(F.struct(F.lit(0).alias("pri"), F.col("source_file").alias("name")), F.struct(F.lit(1).alias("pri"), F.col("module").alias("name")))).alias("n")).select("ord", "n.*")
    known = routes.select(F.col("source_rel").alias("name"), "route", F.coalesce("title", "route").alias("title"))
    best = known.join(F.broadcast(names.where("name <> ''")), "name").groupBy("ord").agg(F.min_by(F.struct("route", "title"), F.struct("pri", "route")).alias("r"))
    return hits.join(best, "ord", "left").select(*hits.columns, "r.route", "r.title")


def best_routed(hits: DataFrame) -> DataFrame:
    """The best hit of each route of :func:`routed`; hits without a route are left out."""
    return hits.where("route is not null").withColumn("_n", F.row_number().over(Window.partitionBy("route").orderBy("ord"))).where("_n = 1").drop("_n")


def unmapped(hits: DataFrame) -> DataFrame:
    """(unmapped): how many hits of :func:`routed` have no route."""
    return hits.agg(F.count_if(F.col("route").isNull()).alias("unmapped"))


def best_per_route(hits: DataFrame, routes: DataFrame, on: str, source: Column | None = None, top_k: int = 20) -> DataFrame:
    """Hits (with ord) joined to (on, route, title), the best of each route kept; ``source`` filters after the cut.

    The cut bounds the hits, so they are what is broadcast.
    """
    cut = hits.where(F.col("ord") <= top_k)
    cut = cut if source is None else cut.where(source)
    named = routes.join(F.broadcast(cut), on)
    return named.withColumn("_n", F.row_number().over(Window.partitionBy("route").orderBy("ord"))).where("_n = 1").drop("_n")


def neighbours(hits: DataFrame, chunks: DataFrame, file_col: str, pos_col: str, radius: int = 2, lexicographic: bool = False) -> DataFrame:
    """Chunks within ``radius`` places of a hit in the same file, hits included, each once, with ``ctx`` their order.

    A hit names 2 * radius + 1 places, so the join is an equi-join on (file, place) and stays linear for files of any length.
    """
    n = Window.partitionBy(file_col).orderBy(pos_col)
    places = hits.select(file_col, F.explode(F.sequence(F.col(pos_col) - radius, F.col(pos_col) + radius)).alias(pos_col)).distinct()
    got = chunks.join(places, [file_col, pos_col])
    order = F.concat_ws("::", F.col(file_col).cast("string"), F.col(pos_col).cast("string")) if lexicographic else F.col(pos_col)
    return got.withColumn("ctx", F.row_number().over(n if not lexicographic else Window.partitionBy(file_col).orderBy(order)))


def positions(chunks: DataFrame, file_col: str, index_col: str, out: str = "pos") -> DataFrame:
    """Place of each chunk in its file, from 0 without gaps."""
    return chunks.withColumn(out, F.row_number().over(Window.partitionBy(file_col).orderBy(index_col)) - 1)


def prompt(parts: DataFrame, keys: Sequence[str], order: str, text_col: str, most: int = CONTEXT_CHARS) -> DataFrame:
    """(keys, context): the texts within the budget, joined by a rule. The budget bounds what is gathered for a key."""
    kept = context_budget(parts, keys, [order], text_col, most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text_col))), lambda x: x[text_col]), "\n---\n")
    return kept.groupBy(*keys).agg(joined.alias("context"))
