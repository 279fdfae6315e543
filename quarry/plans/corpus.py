"""Registered queries over the corpus: retrieval, context, ingest, text transforms, document tree.

No table relates documents to vectors; hybrid queries pair doc_id with vec_id. The scorer of ``hybrid_reranked`` is a plain lexical
one that stands where a model would be plugged in.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import markdown, segment, text
from quarry.operators import doctree, ingest, lexical, ranking, retrieval, vectors
from quarry.sources import scratch
from quarry.sources.readers import table

TERMS = ["est", "entin", "the"]


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


_indexes: dict[tuple[str, str], lexical.Index] = {}


def _index(spark, d) -> lexical.Index:
    """The folder's index, made once in an application: its tables don't change while it runs."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = lexical.index(_docs(spark, d), "doc_id", "text")
    return _indexes[key]


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def _query_vector(spark, d) -> list[float]:
    return _vectors(spark, d).where("vec_id = 0").select("embedding").first()[0]


def bm25_top(spark, d):
    return lexical.bm25_top(_index(spark, d), TERMS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_scores(spark, d):
    return lexical.bm25(_index(spark, d), TERMS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_corpus_stats(spark, d):
    return lexical.corpus_stats(_index(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_floored")


def bm25_idf(spark, d):
    return lexical.idf(_index(spark, d), TERMS).select("term", "df", F.round("idf", 6).alias("idf"))


def vector_topk(spark, d):
    return retrieval.vector_top(_vectors(spark, d), _query_vector(spark, d), 40).select(F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


_files: dict[tuple[str, str], vectors.Index] = {}


def _vector_index(spark, d) -> vectors.Index:
    key = (spark.sparkContext.applicationId, d)
    if key not in _files:
        _files[key] = vectors.index(_vectors(spark, d))
    return _files[key]


def vector_index_topk(spark, d):
    """The same by the inverted file: codes of all lists choose ten rows for each result, vectors score them and the lists that could hold better ones."""
    ix = _vector_index(spark, d)
    return vectors.search(ix, _query_vector(spark, d), 40, probe=ix.lists, refine=10).select(F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


def vector_index_batch(spark, d):
    """Every fifth vector as a query, its 40 nearest of the lists it probes."""
    rows = _vectors(spark, d)
    found = vectors.search_all(_vector_index(spark, d), rows.where("vec_id % 5 = 0"), 40, id_col="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


def bm25_updated(spark, d):
    """Scores after an update of the stored index: some documents changed, some removed, some added again as others."""
    ix, docs = _index(spark, d), _docs(spark, d).select(F.col("doc_id").alias("id"), "text")
    changed = docs.where("id % 7 = 0").withColumn("text", F.concat("text", F.lit(" est entin")))
    added = docs.where("id % 13 = 0").select((F.col("id") + 1_000_000).alias("id"), "text")
    now = lexical.update(ix, changed.union(added), docs.where("id % 11 = 0 and id % 7 > 0").select("id"))
    return lexical.bm25(now, TERMS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _candidates(spark, d):
    return retrieval.candidates(_index(spark, d), _vectors(spark, d), TERMS, _query_vector(spark, d), pool=60, top_k=5)


def hybrid_candidates(spark, d):
    return _candidates(spark, d).select("ord", F.col("id").alias("doc_id"), "leg", "sim")


def hybrid_degraded(spark, d):
    return retrieval.search(_candidates(spark, d), 10).select("ord", F.col("id").alias("doc_id"), "content", "score")


def bm25_batch(spark, d):
    """All benchmark items as queries, the ten best documents of each."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.words(F.col("text")).alias("terms"))
    return lexical.bm25_queries(_index(spark, d), asked, 10).select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def overlap_score() -> F.Column:
    """Share of the text's words that are query words, as a logit-like number."""
    w = text.words(F.col("text"))
    return 8.0 * F.size(F.filter(w, lambda x: x.isin(*TERMS))) / F.greatest(F.size(w), F.lit(1)) - 1.0


def hybrid_reranked(spark, d):
    return retrieval.search(_candidates(spark, d), 10, scorer=overlap_score()).select("ord", F.col("id").alias("doc_id"), "content", "score")


def best_hit_per_source(spark, d):
    hits = lexical.bm25_top(_index(spark, d), TERMS, 200)
    hits = hits.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    routes = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("route"), F.col("lang").alias("title"))
    best = retrieval.best_per_route(hits, routes, "id", F.col("id") % 2 == 0, top_k=200)
    return best.select("ord", F.col("id").alias("doc_id"), "route", "title")


def routed_hits(spark, d):
    """Lexical hits with metadata by the text's hash, named by file or, for files that are no page, by module."""
    hits = lexical.bm25_top(_index(spark, d), TERMS, 200)
    docs = _docs(spark, d).select("doc_id", "lang", "source", text.content_hash(F.col("text")).alias("h"))
    hits = docs.select(F.col("doc_id").alias("id"), "h").join(F.broadcast(hits), "id").withColumn("ord", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    metas = docs.where("doc_id % 3 > 0").select("h", F.col("doc_id").alias("ord"), F.col("source"), F.col("lang").alias("module"), F.col("lang").alias("language"), F.concat("source", F.lit(".md")).alias("source_file"))
    pages = docs.select("source").distinct().where("source like '%1'").select(F.concat("source", F.lit(".md")).alias("source_rel"), F.concat(F.lit("/"), "source", F.lit("/")).alias("route"), F.lit(None).cast("string").alias("title"))
    pages = pages.union(docs.select("lang").distinct().where("lang <> 'en'").select("lang", F.concat(F.lit("/"), "lang", F.lit("/")), F.upper("lang")))
    return retrieval.routed(retrieval.with_metadata(hits, metas), pages).select("ord", F.col("id").alias("doc_id"), "source", "module", "language", "source_file", "route", "title")


def expanded_results(spark, d):
    """The best documents, then their neighbours by doc_id whose text isn't among them yet."""
    found = retrieval.search(_candidates(spark, d), 10)
    docs = _docs(spark, d)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    found = texts.join(F.broadcast(found.select("id", "ord")), "id")
    rows = docs.select(F.lit(0).alias("f"), F.col("doc_id").cast("long").alias("pos"), F.col("doc_id").alias("id"), "text")
    around = retrieval.neighbours(found.select(F.lit(0).alias("f"), F.col("id").cast("long").alias("pos")), rows, "f", "pos")
    return retrieval.with_neighbours(found, around).select(F.col("id").alias("doc_id"), "ord", F.md5(F.col("text").cast("binary")).alias("md5"))


def context_expand(spark, d):
    turns = retrieval.positions(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    hits = turns.where("length(text) % 17 = 0").select("conv_id", "pos")
    return retrieval.neighbours(hits, turns, "conv_id", "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "turn", F.col("ctx").cast("long").alias("ctx"))


def context_budget(spark, d):
    rows = _docs(spark, d).select("source", "doc_id", "text")
    return ranking.context_budget(rows, ["source"], ["doc_id"], "text").select("source", "doc_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


def prompt_context(spark, d):
    return retrieval.prompt(_docs(spark, d), ["lang"], "doc_id", "text").select("lang", F.md5(F.col("context").cast("binary")).alias("md5"), F.length("context").alias("n_chars"))


def content_dedup_first(spark, d):
    return ranking.keep_first_by(_docs(spark, d), text.content_hash(F.col("text")), "doc_id", ["n_chars"]).select("doc_id", "lang", "n_chars")


def md5_duplicates(spark, d):
    from quarry.operators.usage import duplicate_keys

    return duplicate_keys(_docs(spark, d), text.content_hash(F.col("text")))


def width_to_full(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.to_full_width(F.col("text")).cast("binary")).alias("md5"))


def width_round_trip(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.to_half_width(text.to_full_width(F.col("text"))).cast("binary")).alias("md5"))


def drop_blank_lines(spark, d):
    body = F.replace(F.col("text"), F.lit(". "), F.lit("\n \n"))
    return _docs(spark, d).select("doc_id", F.md5(text.drop_blank_lines(body).cast("binary")).alias("md5"))


def json_props(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNull().alias("bad"))


def source_digest(spark, d):
    from quarry.functions.labels import source_digest as digest

    rows = ranking.top_per_key(_docs(spark, d).select("source", "doc_id", "n_chars", "text"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 7, rank="r")
    one = F.struct("r", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source"), (1 / F.col("r")).alias("score"), F.col("text").alias("content"))
    lists = rows.groupBy("source").agg(F.array_sort(F.collect_list(one)).alias("s"))
    items = F.from_json(digest(F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["score"].alias("score"), x["content"].alias("content")))), "array<struct<source:string,score:double,preview:string>>")
    return lists.select("source", F.posexplode(items).alias("at", "i")).select(F.col("source").alias("route"), F.col("at").cast("long").alias("at"), "i.source", "i.score", "i.preview")


def chunk_documents(spark, d):
    return ingest.chunk(_docs(spark, d), "doc_id", "text", F.col("source"))


def chunk_sections(spark, d):
    """Chunks of texts with a heading at each sentence and blank lines within them."""
    body = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n## ")), F.lit(", "), F.lit(",\n \n"))
    return ingest.chunk(_docs(spark, d).select("doc_id", "source", body.alias("text")), "doc_id", "text", F.col("source"))


def segmented_terms(spark, d):
    """How often each word is found in the conversations when their spaces and marks are taken out, by a dictionary of the benchmark's words."""
    counted = table(spark, d, "benchmark").select(F.explode(text.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    cut = segment.tokenizer(spark, {r["w"]: r["n"] for r in counted.orderBy(F.desc("n"), "w").limit(100_000).collect()})
    closed = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    return table(spark, d, "conversations").select(F.explode(cut(closed)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def cache_misses(spark, d):
    cache = _docs(spark, d).where("doc_id % 3 = 0").select(text.content_hash(F.col("text")).alias("key"), F.col("lang").alias("translated")).dropDuplicates(["key"])
    return ingest.split_by_cache(_docs(spark, d).select("doc_id", "text"), cache)[1].select("doc_id", "key")


def _states(spark, d):
    docs = _docs(spark, d).select(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    before = ingest.manifest(docs.where("doc_id % 7 > 0"), "path", "text")
    return before, ingest.manifest(docs.where("doc_id % 11 > 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "path", "text")


def drift(spark, d):
    return ingest.drift(*_states(spark, d))


def changed_paths(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), "doc_id", text.content_hash(F.col("text")).alias("md5"))
    return ingest.changed_paths(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 6 = 0"), docs.where("doc_id % 4 = 0"), docs.where("doc_id % 8 = 0").select("md5"))


def corpus_fingerprint(spark, d):
    return ingest.fingerprint(_docs(spark, d), "doc_id", "text", depth=2)


def content_tree(spark, d):
    return ingest.content_tree(ingest.manifest(_docs(spark, d), "doc_id", "text"), depth=2).select("level", "slice", "digest", "n")


def drift_by_trees(spark, d):
    """The same as ``drift``, by the hash trees of both states."""
    before, after = _states(spark, d)
    trees = [scratch.stored(ingest.content_tree(m, depth=2)) for m in (before, after)]
    return ingest.drift_by_trees(before, after, *trees, depth=2)


def path_hierarchy(spark, d):
    route = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    found = table(spark, d, "pages").select(route.alias("route"), F.concat(F.lit("page "), F.regexp_extract(route, r"(\d+)", 1)).alias("title"), F.regexp_extract(route, r"(\d+)", 1).cast("int").alias("ord"))
    return doctree.tree(found).select("route", "parent", F.col("depth").cast("long").alias("depth"), "title", "ord", "synthetic")


def tree_order(spark, d):
    route = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    nodes = doctree.tree(table(spark, d, "pages").select(route.alias("route"), F.lit("t").alias("title")))
    return doctree.numbered(nodes).select("route", "parent", F.col("nth").cast("long").alias("nth"))


def _site_nodes(spark, d):
    route = F.regexp_extract("url", r"^[a-z]+://([^/]+/[^?#]*)", 1)
    return doctree.tree(table(spark, d, "pages").select(route.alias("route"), F.lit("t").alias("title")))


def nested_tree(spark, d):
    """The hierarchy of all hosts' pages as nested JSON, a piece for each node."""
    return doctree.nested_parts(doctree.intervals(_site_nodes(spark, d)))


def tree_intervals(spark, d):
    return doctree.intervals(_site_nodes(spark, d)).select("route", "enter", "leave")


def markdown_images(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.sum(markdown.image_count(F.concat(F.lit("![a](b(c)) [d](e) "), "text"))).alias("n_images"))


QUERIES = {f.__name__: f for f in (bm25_top, bm25_scores, bm25_corpus_stats, bm25_idf, bm25_batch, bm25_updated, vector_index_topk, vector_index_batch, routed_hits, expanded_results, nested_tree, tree_intervals, vector_topk, hybrid_candidates, hybrid_degraded, hybrid_reranked, best_hit_per_source, context_expand, context_budget, prompt_context, content_dedup_first, md5_duplicates, width_to_full, width_round_trip, drop_blank_lines, json_props, source_digest, chunk_documents, chunk_sections, segmented_terms, cache_misses, drift, changed_paths, corpus_fingerprint, content_tree, drift_by_trees, path_hierarchy, tree_order, markdown_images)}


@lru_cache(maxsize=1)
def _sql() -> dict[str, str]:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    bm = f"""WITH tok AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
        st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM tok) GROUP BY 1),
        raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st), idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw WHERE term IN ({terms})),
        tf AS (SELECT doc_id, len(t) AS dl, i.term, i.idf, len(list_filter(t, lambda x: x = i.term)) AS tf FROM tok, idf i),
        score AS (SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf, st GROUP BY 1 HAVING sum(tf) > 0)"""
    vec = """v AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings)"""
    cand = f"""{bm}, {vec}, lead AS (SELECT vec_id AS doc_id, round(s.sim, 4) AS sim, 0 AS leg, row_number() OVER (ORDER BY s.sim DESC, vec_id) AS r FROM (SELECT * FROM v ORDER BY sim DESC, vec_id LIMIT 60) s WHERE vec_id IN (SELECT doc_id FROM documents)),
        lex AS (SELECT doc_id, 0.0::DOUBLE AS sim, 1 AS leg, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM score WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40)),
        u AS (SELECT a.*, d.text, row_number() OVER (PARTITION BY md5(d.text) ORDER BY leg, r) AS k FROM (SELECT * FROM lead UNION ALL SELECT * FROM lex) a JOIN documents d ON d.doc_id = a.doc_id),
        c AS (SELECT row_number() OVER (ORDER BY leg, r) AS ord, doc_id, leg, sim, text FROM u WHERE k = 1)"""
    lap = f"8.0 * len(list_filter(w, lambda x: x IN ({terms}))) / greatest(len(w), 1) - 1.0"
    html_path = r"regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
    tree = f"""p AS (SELECT {html_path} AS raw FROM pages), s AS (SELECT raw, list_filter(string_split(raw, '/'), lambda x: x <> '') AS s FROM p),
        own AS (SELECT CASE WHEN len(s) = 0 THEN '/' ELSE '/' || array_to_string(s, '/') || '/' END AS route, min('page ' || regexp_extract(raw, '(\\d+)', 1)) AS title, min(nullif(regexp_extract(raw, '(\\d+)', 1), '')::INT) AS ord FROM s GROUP BY 1),
        every AS (SELECT DISTINCT '/' || array_to_string(s[:i], '/') || '/' AS route FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM s) UNION SELECT '/'),
        n AS (SELECT e.route, list_filter(string_split(e.route, '/'), lambda x: x <> '') AS g, o.title, o.ord, o.route IS NULL AS synthetic FROM every e LEFT JOIN own o ON o.route = e.route),
        nodes AS (SELECT route, CASE len(g) WHEN 0 THEN NULL WHEN 1 THEN '/' ELSE '/' || array_to_string(g[:-2], '/') || '/' END AS parent, len(g) AS depth, g, title, ord, synthetic FROM n)"""
    chunked = r"""WITH s AS (SELECT doc_id, source, list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\n(#{1,3}\s)', chr(1) || '\1', 'g'), chr(1)), lambda x: [x]) AS s FROM documents),
            g AS (SELECT doc_id, source, list_reduce(s, lambda a, x: CASE WHEN length(trim(replace(a[-1], chr(10), ''), chr(9) || ' ')) >= 50 THEN a || x ELSE a[:-2] || [a[-1] || chr(10) || x[1]] END) AS g FROM s),
            k AS (SELECT doc_id, source, CASE WHEN length(trim(replace(g[-1], chr(10), ''), chr(9) || ' ')) >= 20 THEN g ELSE g[:-2] END AS g FROM g),
            l AS (SELECT doc_id, source, i, (CASE WHEN length(g[i]) <= 2000 THEN [trim(g[i], chr(9) || chr(10) || ' ')] ELSE list_filter(list_transform(list_reduce(list_transform(regexp_split_to_array(g[i], '\n\s*\n'), lambda x: [x]),
                lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) > 1800 THEN a || x ELSE a[:-2] || [a[-1] || chr(10) || chr(10) || x[1]] END), lambda x: trim(x, chr(9) || chr(10) || ' ')), lambda x: length(x) >= 20) END) AS l
                FROM k, range(1, len(g) + 1) AS r(i)), c AS (SELECT doc_id, source, i, unnest(l) AS text, generate_subscripts(l, 1) AS j FROM l), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_index FROM c)
            SELECT md5(concat_ws('|', source, doc_id, chunk_index, md5(text))) AS chunk_id, doc_id AS source_file, chunk_index, text, md5(text) AS chunk_hash, source FROM n"""
    drift = """WITH b AS (SELECT 'p/' || doc_id AS path, md5(text) AS m FROM documents WHERE doc_id % 7 > 0), a AS (SELECT 'p/' || doc_id AS path, md5(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS m FROM documents WHERE doc_id % 11 > 0)
            SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.m IS NULL THEN 'added' WHEN a.m IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.path = b.path WHERE a.m IS DISTINCT FROM b.m"""
    hashes = """low AS (SELECT md5(k)[:2] AS slice, sha256(string_agg(k || ' ' || v || chr(10), '' ORDER BY k, v)) AS digest, count(*) AS n FROM e GROUP BY 1),
            mid AS (SELECT slice[:1] AS slice, sha256(string_agg(slice || ' ' || digest || chr(10), '' ORDER BY slice)) AS digest, sum(n)::BIGINT AS n FROM low GROUP BY 1), top AS (SELECT '' AS slice, sha256(string_agg(slice || ' ' || digest || chr(10), '' ORDER BY slice)) AS digest, sum(n)::BIGINT AS n FROM mid)"""
    half, full = "".join(chr(c) for c in range(0x20, 0x7F)).replace("'", "''"), text.FULL
    return {
        "bm25_top": f"{bm} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM score WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40)",
        "bm25_scores": f"{bm} SELECT doc_id, round(score, 6) AS score FROM score WHERE score > 0",
        "bm25_corpus_stats": f"{bm} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM raw) AS n_terms, (SELECT count(*) FROM raw WHERE r < 0) AS n_floored FROM st",
        "bm25_idf": """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents),
            r AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM t GROUP BY 1)
            SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM r) ELSE r END, 6) AS idf FROM r WHERE term IN ('est', 'entin', 'the')""",
        "bm25_batch": f"""{bm}, every AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
            q AS (SELECT item_id AS query_id, t.term, count(*) AS times FROM benchmark, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS t(term) GROUP BY 1, 2),
            p AS (SELECT doc_id, len(t) AS dl, u.term, count(*) AS tf FROM tok, unnest(t) AS u(term) GROUP BY 1, 2, 3),
            sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN every USING (term) JOIN p USING (term), st GROUP BY 1, 2),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score FROM sc WHERE score > 0) SELECT * FROM r WHERE rank <= 10""",
        "routed_hits": f"""{bm}, h AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS ord FROM (SELECT * FROM score WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 200)),
            m AS (SELECT md5(text) AS h, arg_max(source, doc_id) AS source, arg_max(lang, doc_id) AS lang FROM documents WHERE doc_id % 3 > 0 GROUP BY 1),
            x AS (SELECT h.ord, h.doc_id, m.h IS NULL AS new, m.source, m.lang FROM h JOIN documents d ON d.doc_id = h.doc_id LEFT JOIN m ON m.h = md5(d.text))
            SELECT ord, doc_id, CASE WHEN new THEN 'bm25_match' ELSE source END AS source, coalesce(lang, '') AS module, CASE WHEN new THEN 'zh' ELSE lang END AS language, coalesce(source || '.md', '') AS source_file,
                CASE WHEN source LIKE '%1' THEN '/' || source || '/' WHEN lang <> 'en' THEN '/' || lang || '/' END AS route, CASE WHEN source LIKE '%1' THEN '/' || source || '/' WHEN lang <> 'en' THEN upper(lang) END AS title FROM x""",
        "expanded_results": f"""{cand}, f AS (SELECT row_number() OVER (ORDER BY sim DESC, ord) AS i, doc_id, text FROM (SELECT * FROM c ORDER BY sim DESC, ord LIMIT 10)),
            n AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE EXISTS (SELECT 1 FROM f WHERE abs(f.doc_id - documents.doc_id) <= 2)),
            a AS (SELECT doc_id, md5(text) AS md5, 0 AS leg, i FROM f UNION ALL SELECT doc_id, md5(text), 1, i FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY leg, i) AS k FROM a)
            SELECT doc_id, row_number() OVER (ORDER BY leg, i)::INT AS ord, md5 FROM k WHERE leg = 0 OR k = 1""",
        "chunk_documents": chunked,
        "chunk_sections": chunked.replace("FROM documents", "FROM (SELECT doc_id, source, replace(replace(text, '. ', '.' || chr(10) || '## '), ', ', ',' || chr(10) || ' ' || chr(10)) AS text FROM documents)"),
        "vector_index_topk": f"WITH {vec} SELECT vec_id, round(sim, 4) AS sim FROM (SELECT * FROM v ORDER BY sim DESC, vec_id LIMIT 40)",
        "bm25_updated": bm.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' est entin' ELSE text END AS text FROM documents WHERE doc_id % 11 > 0 OR doc_id % 7 = 0 UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 13 = 0))") + " SELECT doc_id, round(score, 6) AS score FROM score WHERE score > 0",
        "vector_topk": f"WITH {vec} SELECT vec_id, round(sim, 4) AS sim FROM (SELECT * FROM v ORDER BY sim DESC, vec_id LIMIT 40)",
        "hybrid_candidates": f"{cand} SELECT ord::INT AS ord, doc_id, leg, sim FROM c",
        "hybrid_degraded": f"{cand} SELECT row_number() OVER (ORDER BY sim DESC, ord)::INT AS ord, doc_id, text[:500] AS content, sim AS score FROM (SELECT * FROM c ORDER BY sim DESC, ord LIMIT 10)",
        "hybrid_reranked": f"""{cand}, w AS (SELECT c.*, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM c), b AS (SELECT *, {lap} AS b FROM w)
            SELECT row_number() OVER (ORDER BY b DESC, ord)::INT AS ord, doc_id, text[:500] AS content, round(1 / (1 + exp(-b)), 4) AS score FROM (SELECT * FROM b ORDER BY b DESC, ord LIMIT 10)""",
        "best_hit_per_source": f"""{bm}, h AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS ord FROM (SELECT * FROM score WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 200)),
            k AS (SELECT ord, h.doc_id, source AS route, lang AS title, row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM h JOIN documents d ON d.doc_id = h.doc_id WHERE h.doc_id % 2 = 0) SELECT ord::INT AS ord, doc_id, route, title FROM k WHERE k = 1""",
        "context_expand": """WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), h AS (SELECT conv_id, pos FROM p WHERE length(text) % 17 = 0)
            SELECT conv_id, pos, turn, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS ctx FROM p WHERE EXISTS (SELECT 1 FROM h WHERE h.conv_id = p.conv_id AND abs(h.pos - p.pos) <= 2)""",
        "context_budget": """WITH b AS (SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents),
            k AS (SELECT source, doc_id, text[:(8000 - b)::BIGINT] AS text FROM b WHERE b + length(text) <= 8000 OR 8000 - b > 200) SELECT source, doc_id, length(text)::INT AS n_chars, md5(text) AS md5 FROM k""",
        "prompt_context": """WITH b AS (SELECT lang, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents),
            k AS (SELECT lang, doc_id, text[:(8000 - b)::BIGINT] AS text FROM b WHERE b + length(text) <= 8000 OR 8000 - b > 200), j AS (SELECT lang, string_agg(text, chr(10) || '---' || chr(10) ORDER BY doc_id) AS c FROM k GROUP BY 1) SELECT lang, md5(c) AS md5, length(c)::INT AS n_chars FROM j""",
        "content_dedup_first": "SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars, doc_id) AS k FROM documents) WHERE k = 1",
        "md5_duplicates": "SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "width_to_full": f"SELECT doc_id, md5(translate(text, '{half}', '{full}')) AS md5 FROM documents",
        "width_round_trip": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "drop_blank_lines": "SELECT doc_id, md5(array_to_string(list_filter(string_split(replace(text, '. ', chr(10) || ' ' || chr(10)), chr(10)), lambda x: regexp_matches(x, '\\S')), chr(10))) AS md5 FROM documents",
        "json_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NOT json_valid(props) AS bad FROM events",
        "source_digest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
            SELECT source AS route, r - 1 AS at, 'doc ' || doc_id AS source, round(1 / r, 4) AS score, trim(regexp_replace(text, '\\s+', ' ', 'g'))[:80] AS preview FROM r WHERE r <= 5""",
        "cache_misses": "SELECT doc_id, md5(text) AS key FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)",
        "drift": drift,
        "drift_by_trees": drift,
        "changed_paths": """WITH d AS (SELECT doc_id, md5(text) AS m FROM documents), u AS (SELECT doc_id, 0 AS ord FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 1 FROM d WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 2 FROM d WHERE doc_id % 4 = 0 AND m NOT IN (SELECT m FROM d WHERE doc_id % 8 = 0))
            SELECT doc_id::VARCHAR AS path, min(ord) AS ord FROM u GROUP BY doc_id""",
        "corpus_fingerprint": f"WITH e AS (SELECT doc_id::VARCHAR AS k, length(text)::VARCHAR AS v FROM documents), {hashes} SELECT digest[:16] AS fingerprint FROM top",
        "content_tree": f"WITH e AS (SELECT doc_id::VARCHAR AS k, md5(text) AS v FROM documents), {hashes} SELECT 2 AS level, * FROM low UNION ALL SELECT 1, * FROM mid UNION ALL SELECT 0, * FROM top",
        "path_hierarchy": f"WITH {tree} SELECT route, parent, depth, coalesce(title, CASE WHEN route = '/' THEN '{doctree.ROOT_TITLE}' ELSE g[-1] END) AS title, ord, synthetic FROM nodes",
        "tree_order": f"WITH {tree} SELECT route, parent, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN NOT synthetic THEN 't' WHEN route = '/' THEN '{doctree.ROOT_TITLE}' ELSE g[-1] END, route) AS nth FROM nodes",
        "nested_tree": f"""WITH {tree.replace(html_path, "regexp_extract(url, '^[a-z]+://([^/]+/[^?#]*)', 1)")}, t AS (SELECT route, depth, g, synthetic, CASE WHEN NOT synthetic THEN 't' WHEN route = '/' THEN '{doctree.ROOT_TITLE}' ELSE g[-1] END AS title FROM nodes),
            up AS (SELECT route, i, CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(g[:i], '/') || '/' END AS a FROM t, unnest(range(0, len(g) + 1)) AS u(i)),
            k AS (SELECT up.route, list(struct_pack(t := t.title, r := t.route) ORDER BY i) AS k FROM up JOIN t ON t.route = up.a GROUP BY 1),
            o AS (SELECT t.*, row_number() OVER w - 1 AS pos, lag(depth) OVER w AS was, lead(depth, 1, 0) OVER w AS next FROM t JOIN k ON k.route = t.route WINDOW w AS (ORDER BY k.k))
            SELECT pos AS enter, route, CASE WHEN was >= depth THEN ',' ELSE '' END || '{{"route":"' || route || '","title":"' || title || '","synthetic":' || synthetic || ',"children":['
                || repeat(']}}', CASE WHEN pos = (SELECT max(pos) FROM o) THEN depth + 1 ELSE greatest(depth - next + 1, 0) END) AS part FROM o""",
        "tree_intervals": f"""WITH {tree.replace(html_path, "regexp_extract(url, '^[a-z]+://([^/]+/[^?#]*)', 1)")}, t AS (SELECT route, g, CASE WHEN NOT synthetic THEN 't' WHEN route = '/' THEN '{doctree.ROOT_TITLE}' ELSE g[-1] END AS title FROM nodes),
            up AS (SELECT route, i, CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(g[:i], '/') || '/' END AS a FROM t, unnest(range(0, len(g) + 1)) AS u(i)),
            k AS (SELECT up.route, list(struct_pack(t := t.title, r := t.route) ORDER BY i) AS k FROM up JOIN t ON t.route = up.a GROUP BY 1),
            o AS (SELECT route, row_number() OVER (ORDER BY k) - 1 AS enter FROM k), sizes AS (SELECT a AS route, count(*) AS n FROM up GROUP BY 1)
            SELECT o.route, enter, enter + n - 1 AS leave FROM o JOIN sizes ON sizes.route = o.route""",
        # After an image mark: its label ends at the first bracket, a round one follows, and pairs of those inside taken out, the target ends before any white space.
        "markdown_images": r"""SELECT lang, (count(*) + sum(len(list_filter(string_split(text, '![')[2:], lambda x: strpos(x, '](') > 0 AND strpos(x, '](') = strpos(x, ']')
            AND regexp_matches(regexp_replace(x[strpos(x, '](') + 2:], '[(][^\s()]*[)]', '', 'g'), '^[^\s()]*[)]')))))::BIGINT AS n_images FROM documents GROUP BY 1""",
    }


SQL = _sql()
