"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, decontaminate, html, langid, lexical, linededup, minhash, mixing, resampling, sharding, toxicity, vectors
from quarry.llm.common import read

SHARDS = 24
MODEL = "piece_bpe_32k.model"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), stored=True).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels say toxic or not: two grades, and severity is the probability of the upper one."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, grade_col="toxic")
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), "severity", "toxic", "probabilities")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n_words=2).withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, profiles).select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score", "distance")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), digests=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    found = lexical.search(lexical.index(read(spark, sf_dir, "documents"), terms=lexical.distinct_terms(items)), items)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit, names = decontaminate.n_hit(), F.array_join("items", ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_sharding, op3_vector_neardup, op4_mixing, op5_toxicity, op6_minhash, op7_line_dedup, op8_main_text, op9_language, op10_bpe, op11_resampling, op12_lexical, op13_decontaminate)}

SQL = {
    "op3_vector_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id),
        comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT e.vec_id, count(l.b) AS n_links, any_value(c.component_id) AS component_id, e.vec_id = any_value(c.component_id) AS kept
        FROM embeddings e JOIN comp c ON c.id = e.vec_id LEFT JOIN link l ON l.a = e.vec_id GROUP BY e.vec_id""",
    "op6_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        x AS (SELECT doc_id, unnest(s) AS g FROM s),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT p.a, p.b FROM pair p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
        both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id),
        comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp ON comp.id = s.doc_id""",
    "op7_line_dedup": r"""
        WITH line AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
        d AS (SELECT k, min(doc_id) AS least FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> d.least, false) AS gone FROM k LEFT JOIN d ON d.k = k.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_resampling": r"""
        WITH w AS MATERIALIZED (SELECT 0 AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
            UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
        feature AS MATERIALIZED (SELECT kind, doc_id, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n FROM w, range(1, 4) AS n(k), range(1, len(w) - k + 2) AS r(i) GROUP BY 1, 2, 3),
        tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
        byte AS (SELECT g, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM (SELECT DISTINCT g FROM feature)),
        hashed AS MATERIALIZED (SELECT g, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM byte, tab),
        f AS MATERIALIZED (SELECT kind, doc_id, bucket, sum(n)::BIGINT AS n FROM feature JOIN hashed USING (g) GROUP BY 1, 2, 3),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0)::BIGINT AS t FROM f GROUP BY 1),
        gain AS MATERIALIZED (SELECT bucket, floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM c)::DOUBLE + 10000)) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c)::DOUBLE + 10000))))::BIGINT AS gain FROM c),
        d AS (SELECT doc_id, sum(f.n)::BIGINT AS n_features, sum(f.n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE kind = 0 GROUP BY 1),
        x AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('42:' || w.doc_id)[:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE kind = 0),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
        SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM x WHERE n_words >= 20) THEN rank END AS rank FROM x LEFT JOIN r ON r.doc_id = x.doc_id""",
    "op12_lexical": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
        st AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
        p AS MATERIALIZED (SELECT doc_id, len(w) AS dl, t.term, count(*) AS tf FROM d, unnest(w) AS t(term) GROUP BY 1, 2, 3),
        wt AS MATERIALIZED (SELECT term, floor(1000.0::DOUBLE * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, st GROUP BY term, n),
        g AS MATERIALIZED (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * dl * n) // l)) AS g FROM p, st),
        s AS (SELECT item_id, doc_id, sum(times * w * g)::BIGINT AS score FROM (SELECT item_id, term, count(*) AS times FROM b GROUP BY 1, 2) q JOIN wt USING (term) JOIN g USING (term) GROUP BY 1, 2),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
    "op13_decontaminate": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM b, range(1, len(w) - least(10, len(w)) + 2) AS r(i) WHERE len(w) > 0),
        ks AS MATERIALIZED (SELECT DISTINCT k FROM win),
        gram AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, range(1, len(w) - k + 2) AS r(i)),
        hit AS MATERIALIZED (SELECT doc_id, item_id, gram.k, i FROM gram JOIN win ON win.k = gram.k AND win.g = gram.g),
        n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, k) AS r(j) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
}
