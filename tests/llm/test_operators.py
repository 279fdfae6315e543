"""The ten operators against SQL, brute force, the tokenizer's library, held-out labels and small fixtures of edge cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ann, bpe, html, langid, linededup, minhash, mixing, queries, sharding, toxicity, vectors
from tests.compare import database, differences

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, label string, band int"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and sources, repeats, ties, a very long text, columns with names used inside."""
    long = "wort über allem und nichts dabei " * 20_000
    t = "the same line of text here\nand another line of words\n"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, t, "en", "a"), (3, t, "en", "a"), (4, t, None, None), (5, long, "de", "b"), (6, long + " x", "de", "b"), (None, t, "en", "a"), (7, " \t\n", "en", "c"), (8, "1234 5678", "en", "c"), (9, "▁ a▁b  c", "en", "c")]
    return spark.createDataFrame([(*r, 0, "r", "i", "l", 1) for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, FOLDER, queries.QUERIES[name], queries.SQL[name]) == []


def test_nearest_recall_and_scores(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    v = np.array(table["embedding"].tolist(), float)
    ids = table["vec_id"].to_numpy()
    hits = total = 0
    found = queries.op1_ann(spark, FOLDER).toPandas()
    for q, part in found.groupby("query_id"):
        s = v @ v[np.flatnonzero(ids == q)[0]]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part["vec_id"])
        assert np.allclose(part["score"], [s[np.flatnonzero(ids == i)[0]] for i in part["vec_id"]])
        hits, total = hits + len(set(best) & set(part["vec_id"])), total + 20
    assert set(found["query_id"]) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9


def test_nearest_recall_over_full_shards(spark):
    """Queries over five shards of about 8,000, of which each holds a query in one alone."""
    r = np.random.default_rng(0)
    v = r.standard_normal((40_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id long, embedding array<double>").repartition(8)
    found = ann.nearest(df, F.col("vec_id") % 200 == 0, k=20).toPandas()
    hits = 0
    for q, part in found.groupby("query_id"):
        s = v @ v[q]
        s[q] = -2
        hits += len(set(np.argpartition(-s, 20)[:20]) & set(part["vec_id"]))
    print("recall", hits / (20 * 200))
    assert found["query_id"].nunique() == 200 and hits / (20 * 200) >= 0.9


@pytest.mark.parametrize("kind", ["one of 1e4", "one of 1e20", "powers", "lognormal"])
def test_nearest_recall_with_uneven_norms(spark, monkeypatch, kind):
    """Several shards, blocks and steps."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    r = np.random.default_rng(1)
    v = r.standard_normal((4_000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] *= {"one of 1e4": 1e4, "one of 1e20": 1e20}.get(kind, 1)
    v *= {"powers": 10.0 ** r.integers(-3, 9, len(v)), "lognormal": np.exp(r.standard_normal(len(v)))}.get(kind, np.ones(len(v)))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id long, embedding array<double>")
    hits = total = 0
    for q, part in ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=900).toPandas().groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hits, total = hits + len(set(np.argsort(-s, kind="stable")[:20]) & set(part["vec_id"])), total + 20
    assert total == 20 * 200 and hits / total >= 0.97


def test_nearest_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (1, [0.0, 5.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 5.0), (0, 2, 2, 3.0)]


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5, 0.5]), (20, [0.0, 2.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_sharding_law(spark, odd):
    for folder, n in ((SMALL, 24),):
        got = queries.op2_sharding(spark, folder).toPandas()
        base = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas()
        assert sorted(got["doc_id"]) == sorted(base["doc_id"])
        want = {r.doc_id: (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in base.itertuples()}
        assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for _, r in got.iterrows())
        counts = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
        assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all() and len(counts) == n
    out = sharding.shard(odd, 3, bucket_bytes=1000).toPandas()
    assert len(out) == 11 and sorted(Counter(out["shard"]).values()) == [3, 4, 4]
    assert sharding.shard(odd.limit(0), 3).count() == 0


def test_sharding_permutes_uniformly(spark, tmp_path):
    """Equal rows spread over all buckets, not-null columns pass, orders depend on the seed alone, and places don't follow ids."""
    equal = spark.range(8_000).select(F.lit(5).alias("doc_id"), F.lit("x" * 40).alias("text"))
    counts = [r["count"] for r in sharding.shuffle_rows(equal, bucket_bytes=40_000).groupBy("bucket").count().collect()]
    assert len(counts) == 10 and max(counts) < 1_000
    spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(None).cast("int").alias("_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    order = lambda seed: [r["id"] for r in sharding.shuffle_rows(docs, seed=seed, bucket_bytes=10_000).orderBy("place").select("row.doc_id").toDF("id").collect()]
    one, again, other = order(1), order(1), order(2)
    assert one == again and one != other and sorted(one) == list(range(4_000))
    for got in (one, other):
        place = np.argsort(got)
        assert abs(np.corrcoef(place, np.arange(4_000))[0, 1]) < 0.06 and abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.06
        # Each tenth of the ids is spread over each tenth of the places: chi-square of 81 degrees, far under its 0.1% bound.
        cells = np.histogram2d(place, np.arange(4_000), bins=10)[0]
        assert ((cells - 40) ** 2 / 40).sum() < 130


def test_sharding_writes_slots_in_order(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 5, pieces=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [40] * 5
    for f in got.inputFiles():
        slots = [r["slot"] for r in spark.read.parquet(f).select("slot").collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
    assert got.select("row.*").exceptAll(docs).count() == 0 and got.count() == docs.count()


def test_vector_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("inf"), 0.0], 1), (8, [1.0, 0.1], 1), (9, [1.0, 0.1], 1), (10, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    linked = {1: (3, 1, True), 2: (3, 1, False), 8: (3, 1, False), 9: (3, 1, False)}
    assert got == {i: linked.get(i, (0, i, True)) for i in range(1, 11)}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def _planted(n, dim, cosine, seed):
    """n random unit vectors, and for each another at the given cosine."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u, x = unit(r.standard_normal((n, dim))), r.standard_normal((n, dim))
    return u, cosine * u + np.sqrt(1 - cosine**2) * unit(x - (x * u).sum(axis=1, keepdims=True) * u)


@pytest.mark.parametrize("rows", [500, 10_000, 100_000, 1_000_000, 5_000_000])
def test_vectors_at_the_limit_share_a_filter(rows):
    """The code of a table of so many distinct vectors, on pairs at exactly 0.98."""
    u, w = _planted(10_000, 64, 0.98, rows)
    size = int(np.ceil(np.sqrt(rows)))
    assert (vectors.decode(u, size)[:, :, None] == vectors.decode(w, size)[:, None, :]).any(axis=(1, 2)).all()


def test_planted_near_vectors_by_brute_force(spark):
    u, w = _planted(4_000, 64, 0.981, 3)
    v = np.concatenate([u, w, _planted(1_000, 64, 0.97, 4)[1]])
    label = np.arange(len(v)) % 2_000 % 3
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() == 8_000
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), int(min([i, *np.flatnonzero(near[i])]))) for i in range(len(v))}


def test_heavy_buckets_by_brute_force(spark):
    """A cone of 1,500 near vectors and another near it: their buckets are cut in chunks."""
    r = np.random.default_rng(8)
    axis = np.eye(16)[:2]
    v = np.concatenate([axis[0] + 0.02 * r.standard_normal((1_500, 16)), 0.99 * axis[0] + 0.2 * axis[1] + 0.02 * r.standard_normal((700, 16)), r.standard_normal((300, 16))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum(axis=1).max() > vectors.HEAVY
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {x["id"]: (x["n_links"], x["component_id"]) for x in vectors.near_vectors(df).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
    root = np.arange(len(v))
    while not (root == (least := np.minimum(root, np.where(near, root[None, :], len(v)).min(axis=1)))).all():
        root = least
    assert {i: g[1] for i, g in got.items()} == dict(enumerate(root.tolist()))


def test_vectors_equal_sql_where_there_are_links(spark, tmp_path):
    u, w = _planted(150, 16, 0.985, 9)
    v = np.concatenate([u, w, u[:20]])
    df = spark.createDataFrame([(i, x.tolist(), i % 150 % 4) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert differences(spark, con, str(tmp_path), queries.op3_vector_neardup, queries.SQL["op3_vector_neardup"]) == []
    assert queries.op3_vector_neardup(spark, str(tmp_path)).agg(F.sum("n_links")).first()[0] >= 340


def test_mixing(spark, docs, odd):
    got = mixing.mix(docs).toPandas()
    base = docs.toPandas()
    tokens = {r.doc_id: len(r.text.split()) for r in base.itertuples()}
    assert set(got["id"]) == set(base["doc_id"]) and all(tokens[r.id] == r.n_tokens for r in got.itertuples())
    share = got.groupby("source")["n_tokens"].sum() / got["n_tokens"].sum()
    weight = got.groupby("source")["weight"].first()
    assert abs(weight.sum() - 1) < 1e-9 and (share - weight).abs().max() < 0.05
    assert got.groupby(["source", "id"]).size().max() <= 4
    raw = got.drop_duplicates("id").groupby("source")["n_tokens"].sum()
    assert (raw.sort_values().index == weight.sort_values().index).all() or weight.nunique() == 1
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("block")["slot"])
    assert mixing.mix(odd, carry=odd.columns).count() >= 11 and mixing.mix(odd.limit(0)).count() == 0


def _exponent(tokens, entropy, most):
    """By scalar bisection: the largest x in [0, 1] with the entropy and the repetitions in bounds, entropy giving way."""
    p = np.array(tokens) / sum(tokens)

    def bisect(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (low, x) if holds(p**x / (p**x).sum()) else (x, high)
        return high

    flat = bisect(lambda w: -(w * np.log(w)).sum() < entropy * np.log(len(p)))
    few = bisect(lambda w: (max(np.array(tokens) / w) * w / tokens).max() <= most)
    return max(flat, few)


@pytest.mark.parametrize("sizes, entropy, most", [((900, 60, 30), 0.97, 4.0), ((900, 60, 30), 0.6, 100.0), ((400, 390, 5), 0.999, 1e6), ((700, 7, 7, 7), 0.9, 2.0)])
def test_mixing_meets_entropy_and_repetition(spark, sizes, entropy, most):
    """Skewed sources against a scalar bisection, and quotas against the placements."""
    rows = [(i, f"s{k}", " ".join(["w"] * 10)) for i, k in enumerate(np.repeat(np.arange(len(sizes)), sizes).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, target_entropy=entropy, max_repetition=most, block_tokens=500).toPandas()
    tokens = [10 * n for n in sizes]
    x = _exponent(tokens, entropy, most)
    assert 0 < x < 1
    p = np.array(tokens) / sum(tokens)
    want = p**x / (p**x).sum()
    weight = got.groupby("source")["weight"].first().to_numpy()
    assert np.abs(weight - want).max() < 1e-4
    assert got.groupby("id").size().max() <= np.ceil(most) and set(got["id"]) == set(range(len(rows)))
    need = max(np.array(tokens) / want)
    taken = got.groupby("source")["n_tokens"].sum().to_numpy()
    assert (np.abs(taken - want * need) <= 10 + 1e-4 * need).all()
    # Blocks hold the sources in proportion, give or take a document at each end.
    inner = got[(got["block"] > 0) & (got["block"] < got["block"].max())]
    per = inner.pivot_table(index="block", columns="source", values="n_tokens", aggfunc="sum", fill_value=0).to_numpy()
    assert len(per) == 0 or (np.abs(per - 500 * weight) <= 10 + 1e-6).all()


def test_mixing_spreads_what_has_no_tokens(spark):
    rows = [(i, "full", "w " * 50) for i in range(200)] + [(1000 + i, "blank", None) for i in range(200)] + [(5, "same", "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, block_tokens=1_000, max_repetition=1e9, target_entropy=0.0, carry=["doc_id"]).toPandas()
    blank = got[got["source"] == "blank"]
    assert len(blank) == 200 and blank["block"].nunique() > 5 and set(got["id"]) == {r[0] for r in rows}
    assert (got["row"].map(lambda x: x["doc_id"]) == got["id"]).all() and (got["source"] == "same").sum() == 50


def test_mixing_is_native(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString() + queries.op7_line_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 > 0"), grade_col="toxic")
    assert len(model.thresholds) == 1
    scored = toxicity.score(docs, model).toPandas().set_index("id")
    test = labels.where("doc_id % 4 = 0").toPandas().drop_duplicates("doc_id")
    said = np.array([bool(scored.loc[i, "toxic"]) for i in test["doc_id"]])
    true = test["toxic"].to_numpy() == 1
    assert (said & true).sum() / true.sum() > 0.85 and (said & ~true).sum() / (~true).sum() < 0.01
    p = np.array(scored["probabilities"].tolist())
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p @ np.arange(2), scored["severity"])


def test_ordinal_gradient_by_finite_differences():
    r = np.random.default_rng(4)
    grade = r.integers(0, 4, 40)
    rows, cols = np.nonzero(r.random((40, 6)) < 0.4)
    for _ in range(3):
        p = r.standard_normal(6 + 3) * 0.5
        _, g = toxicity.loss(p, rows, cols, 6, grade)
        for i in range(len(p)):
            e = np.eye(len(p))[i] * 1e-6
            assert abs((toxicity.loss(p + e, rows, cols, 6, grade)[0] - toxicity.loss(p - e, rows, cols, 6, grade)[0]) / 2e-6 - g[i]) < 1e-4
    w, theta = toxicity.solve(rows, cols, 6, grade, 4)
    best = np.concatenate([w, theta[:1], np.log(np.diff(theta))])
    assert np.abs(toxicity.loss(best, rows, cols, 6, grade)[1]).max() < 0.05 and (np.diff(theta) > 0).all()


def test_severity_orders_held_out_grades(spark):
    """Grades 0, 1, 2 and 4 (3 is missing) by how many bad words of growing weight a text holds; some ids have two labels."""
    r = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(1_500):
        grade = int(r.choice([0, 1, 2, 4], p=[0.6, 0.2, 0.1, 0.1]))
        words = [f"w{k}" for k in r.integers(0, 300, 30)] + [f"bad{k}" for k in r.integers(0, 5, {0: 0, 1: 1, 2: 3, 4: 8}[grade])]
        rows.append((i, " ".join(r.permutation(words))))
        labels += [(i, grade)] + ([(i, 0)] if i % 50 == 0 else [])
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, grade int")
    model = toxicity.fit(docs, known.where("doc_id % 3 > 0"))
    assert len(model.thresholds) == 4 and model.thresholds == sorted(model.thresholds)
    severity = {x["id"]: x["severity"] for x in toxicity.score(docs, model).collect()}
    means = [np.mean([severity[i] for i, g in labels if g == k and i % 3 == 0 and i % 50]) for k in (0, 1, 2, 4)]
    assert all(b - a > 0.3 for a, b in zip(means, means[1:])), means


def test_toxicity_edge_cases(spark, odd):
    labels = spark.createDataFrame([(2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels, grade_col="toxic")).collect()
    assert len(got) == 11 and not any(r["toxic"] for r in got)
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels.limit(0), grade_col="toxic")).count() == 0


def _jaccard_components(rows, n):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_minhash_five_words_by_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = _jaccard_components(rows, 5)
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(docs, n_words=5).collect()}
    assert got == want


def test_minhash_chains_of_near_copies(spark):
    """A line of copies, each like its neighbours alone: every link joins, although the ends have little in common."""
    r = np.random.default_rng(5)
    text = [f"w{k}" for k in r.integers(0, 10**6, 300)]
    rows = []
    for i in range(120):
        rows.append((int(i), " ".join(text)))
        for k in r.integers(0, 300, 9):
            text[k] = f"v{i}x{k}"
    got = {x["id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2).collect()}
    assert got == _jaccard_components(rows, 2)


def test_minhash_ids_with_several_texts(spark):
    """Links of either text of a repeated id count."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "something else altogether")]
    got = {(r["id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n_words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_minhash_edge_cases(spark, odd):
    got = sorted(((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, n_words=2).collect()), key=str)
    of = {g[0]: g[2] for g in got}
    assert len(got) == 11 and of[4] == 3 and of[6] == 5 and of[1] == 1 and of[2] == 2 and of[7] == 7 and of[None] is None
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    assert {r["doc_id"] for r in minhash.drop_near_duplicates(odd, n_words=2).collect()} == {1, 2, 3, 5, 7, 8, 9, None}


def test_line_dedup_edge_cases(spark, odd):
    got = {(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in linededup.dedup_lines(odd).select("row", "n_lines", "n_dropped", "kept_text").where("length(kept_text) < 1000").collect()}
    t = "the same line of text here\nand another line of words\n"
    assert {(1, 1, 0, ""), (2, 1, 0, ""), (3, 3, 0, t), (4, 3, 2, ""), (None, 3, 0, t), (7, 2, 0, " \t\n"), (8, 1, 0, "1234 5678")} <= got
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_of_a_line_in_most_documents(spark):
    rows = [(i, f"own line number {i}\nA line that nearly all hold\n{'x' * (i % 7)}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = {r["row"]["doc_id"]: r["kept_text"] for r in linededup.dedup_lines(df).select("row", "kept_text").collect()}
    assert got == {i: t if i == 0 else t.replace("A line that nearly all hold\n", "") for i, t in rows}


PAGE = "<html><head><title>T</title><script>x()</script></head><body><nav><a>Home</a></nav><article><h1>Head {i}</h1><p>First &amp; best   {i}\n text<!-- c --></p><p>Second {i}<br>line</p></article><div class='comments'><p>I agree</p></div><footer>Foot</footer></body></html>"


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{i}", str(i))) for i in range(12)] + [(90, None, None), (91, None, ""), (92, "x", "<p>plain <b>text"), (93, "::bad[", "&lt;a&gt; only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in html.extract(pages).collect()}
    assert all(got[i] == f"Head {i}\nFirst & best {i} text\nSecond {i}\nline" for i in range(12))
    assert (got[90], got[91], got[92], got[93]) == ("", "", "plain text", "<a> only")
    assert html.extract(pages.limit(0)).count() == 0


def test_style_tree_drops_what_pages_share(spark):
    body = "<div class='wrap'><div class='strip'><p>Same words on every page</p></div><div class='story'><p>Story number {i} about {i}</p><p>More of {i}</p></div></div>"
    pages = spark.createDataFrame([(i, "http://b.example/x", f"<html><body>{body.replace('{i}', str(i))}</body></html>") for i in range(20)], "page_id long, url string, html string")
    assert all(r["text"] == f"Story number {r['id']} about {r['id']}\nMore of {r['id']}" for r in html.extract(pages).collect())


def _texts(spark, htmls, host="http://c.example/"):
    pages = spark.createDataFrame([(i, f"{host}{i}", x) for i, x in enumerate(htmls)], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in html.extract(pages).collect()}
    return [got[i] for i in range(len(htmls))]


def test_copies_of_pages_keep_their_text(spark):
    """Groups of copies without an article element, and repeated rows alone."""
    page = "<html><body><div class='strip'><p>Same words on every page</p></div><div class='story'><p>Story {i}</p><p>More of {i}</p></div></body></html>"
    for n, copies in ((32, 4), (96, 12), (1, 8)):
        want = [(i, page.replace("{i}", str(i))) for i in range(n // copies or 1) for _ in range(copies)]
        strip = "" if n > 1 else "Same words on every page\n"
        assert _texts(spark, [x for _, x in want]) == [f"{strip}Story {i}\nMore of {i}" for i, _ in want]


@pytest.mark.parametrize("wrapper", ["class='layout with-sidebar'", "class='no-sidebar'", "class='page has-comments'", "class='content-widget'", "class='share-enabled'", "id='notice-board'"])
def test_wrappers_named_after_what_they_lack(wrapper):
    story, more = "<h1>Head</h1><p>A story of some length, told at its own pace</p>", "<div class='sidebar'><p>Side</p></div><div class='comments'><article class='comment'><p>I agree</p></article></div>"
    want = "Head\nA story of some length, told at its own pace"
    for body in (f"<div {wrapper}><article>{story}</article>{more}</div>", f"<div {wrapper}><div {wrapper}><main>{story}</main></div>{more}</div>", f"<article><div {wrapper}>{story}</div></article>{more}", f"<div {wrapper}>{story}{more}</div>"):
        assert html.main_text(f"<html><body>{body}</body></html>") == want
    cards = "<div class='related'>" + "".join(f"<article class='card'><p>Card {i}</p></article>" for i in range(3)) + "</div>"
    assert html.main_text(f"<body><div {wrapper}><article>{story}</article>{cards}</div></body>") == want


LONG = "<p>I read all of this and I think that there is a lot more to say about it than the author did, and here it is, at length</p>" * 3


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>T</h1><p>The short story is here.</p><div class='comments'>{}</div></article>",
        "<main><article><h1>T</h1><p>The short story is here.</p></article><section id='comments'><article class='comment'>{}</article><article>{}</article></section></main>",
        "<main><h1>T</h1><p>The short story is here.</p><article class='comment-body'>{}</article></main>",
        "<article><h1>T</h1><p>The short story is here.</p></article><div class='related-posts'>{}<article>{}</article></div>",
        "<article><h1>T</h1><p>The short story is here.</p><div class='adSlot'>{}</div><div id='feedback-list'>{}</div></article>",
        "<div class='content'><h1>T</h1><p>The short story is here.</p></div><div class='reply'>{}</div>",
        "<article class='post has-comments'><h1>T</h1><div class='content-widget'><p>The short story is here.</p></div><ul class='comments'><li>{}</li></ul></article>",
    ],
)
def test_comments_longer_than_the_article(spark, body):
    """On pages by themselves and on hosts of several pages, with comments that are new on each."""
    page = f"<html><body>{body.replace('{}', LONG)}</body></html>"
    assert html.main_text(page) == "T\nThe short story is here."
    many = [page.replace("story", f"story {i}").replace("I read", f"I, reader {i}, read") for i in range(4)]
    assert _texts(spark, many) == [f"T\nThe short story {i} is here." if "T" in t.split("\n") else f"The short story {i} is here." for i, t in enumerate(_texts(spark, many))]
    assert all(t.endswith(f"The short story {i} is here.") for i, t in enumerate(_texts(spark, many)))


def test_a_page_of_marked_elements_alone_keeps_the_longest(spark):
    assert html.main_text(f"<body><div class='ad-layout'><p>All that this page says</p>{LONG}</div></body>").startswith("All that this page says")


@pytest.mark.parametrize("n", [2, 3, 7])
def test_small_hosts_lose_what_pages_share(spark, n):
    page = "<body><div><p>Same words on every page</p></div><section><p>Story {i}</p><p>More of {i}</p></section></body>"
    assert _texts(spark, [page.replace("{i}", str(i)) for i in range(n)]) == [f"Story {i}\nMore of {i}" for i in range(n)]


def _tree(pages):
    """Importance of each node of one host's tree, recursively, and the leaves of noise, all in plain Python."""
    parsed = {}
    for x in pages:
        page = html.Page(x)
        key = "\0".join(t for _, marked, t in page.blocks if not marked)
        rows = sorted({(p, t) for p, _, t in page.blocks}), {p: tuple(c) for p, c in page.children.items()}
        assert parsed.setdefault(key, rows) == rows
    m = len(parsed)
    texts, layouts = {}, {}
    for blocks, children in parsed.values():
        for p, t in blocks:
            texts.setdefault(p, Counter())[t] += 1
        for p, c in children.items():
            layouts.setdefault(p, Counter())[c] += 1
    inside = lambda p: "article" in p or "main" in p
    letters = lambda p: sum(n * len(t) for q, c in texts.items() for t, n in c.items() if q == p or p == "" or q.startswith(p + "/"))
    kids = lambda p: [q for q in {*texts, *layouts} if q and q.rpartition("/")[0] == p and letters(q)]
    importance = {}

    def walk(p):
        if p in texts:
            n = np.array(list(texts[p].values()))
            value = (html.PRIOR if p.endswith("!") else 1.0) * (1.0 if m == 1 else 1 - (n * np.log(n)).sum() / n.sum() / np.log(m + html.DOUBT * inside(p)))
        else:
            n = np.array(list(layouts[p].values()))
            f = html.G ** (len(n) - 1)
            own = 1.0 if m == 1 else (np.log(n.sum()) - (n * np.log(n)).sum() / n.sum()) / np.log(m)
            value = (1 - f) * own + f * sum(letters(k) / letters(p) * walk(k) for k in kids(p))
        importance[p] = value
        return value

    walk("")
    return importance, {p for p in texts if importance[p] < (html.INSIDE if inside(p) and not p.endswith("!") else html.NOISE)}


def test_style_tree_by_recursion(spark):
    """Two hosts, of varied pages and of one page, against the tree in plain Python: importances, and what is cut."""
    r = np.random.default_rng(3)
    page = lambda i: (
        "<body><div class='top'><p>Welcome</p><p>All pages say this</p></div><nav><a>Home</a></nav>"
        + "".join(f"<section><h2>Part {k} of {i}</h2><p>Text {k} on page {i}</p></section>" for k in range(int(r.integers(1, 4))))
        + ("<div class='note'>Seen on some</div>" if i % 3 == 0 else "")
        + f"<article>Lead {i}<p>Words of {i}</p><blockquote>Every article ends so</blockquote></article><div class='promo'>Buy {i}</div><div>Foot <b>of</b> all</div></body>"
    )
    hosts = {"a.example": [page(i) for i in range(25)], "b.example": [page(99)]}
    rows = [(f"http://{h}/{i}", x) for h, xs in hosts.items() for i, x in enumerate([*xs, xs[0]])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "page_id long, url string, html string")
    got = {(x["host"], x["path"]): x["importance"] for x in html.style_tree(df).collect()}
    texts = {x["id"]: x["text"] for x in html.extract(df).collect()}
    want, cut = {}, {}
    for h, xs in hosts.items():
        importance, cut[h] = _tree(xs)
        want |= {(h, p): v for p, v in importance.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for i, (url, x) in enumerate(rows):
        gone = cut[url.split("/")[2]]
        assert all(p in gone for p, marked, _ in html.Page(x).blocks if marked)
        assert texts[i] == "\n".join(t for p, _, t in html.Page(x).blocks if p not in gone)
    assert "Welcome" not in texts[0] and "Foot" not in texts[0] and "Every article" not in texts[0] and "Words of 0" in texts[0] and "Welcome" in texts[len(rows) - 1]


def test_text_outside_main_stays(spark):
    page = "<body><h1>Headline {i}</h1><div class='lead'>Lead of {i}</div><main><p>Body of {i}</p></main><p>Printed by us</p></body>"
    assert _texts(spark, [page.replace("{i}", str(i)) for i in range(5)]) == [f"Headline {i}\nLead of {i}\nBody of {i}" for i in range(5)]
    assert _texts(spark, [page.replace("{i}", "0")]) == ["Headline 0\nLead of 0\nBody of 0\nPrinted by us"]


def test_near_copies_on_a_small_host_keep_their_text(spark):
    page = "<body><article><p>A long text that both of the pages hold</p><p>And a second paragraph of it</p><p>{i}</p></article></body>"
    assert _texts(spark, [page.replace("{i}", x) for x in ("one", "two")]) == [f"A long text that both of the pages hold\nAnd a second paragraph of it\n{x}" for x in ("one", "two")]


def test_html_join_of_many_hosts_and_odd_rows(spark, monkeypatch):
    """The join in the broadcast's place; null ids, repeats, clashing columns and a very long page."""
    monkeypatch.setattr(html, "BROADCAST_LETTERS", 0)
    strip = "<div class='strip'><p>Same words</p></div>"
    long = f"<body>{strip}" + "".join(f"<p>Paragraph {k}</p>" for k in range(20_000)) + "</body>"
    rows = [(i, f"http://h{i % 5}.example/x", f"<body>{strip}<p>Story {i}</p></body>", "h", "c") for i in range(20)]
    rows += [(None, "http://h0.example/y", rows[0][2], "h", "c"), (3, *rows[3][1:]), (50, "http://h1.example/z", long, None, None), (51, None, "<p>No host</p>", "h", "c")]
    got = Counter((x["id"], x["text"]) for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, cut string")).collect())
    want = Counter([(i, f"Story {i}") for i in range(20)] + [(None, "Story 0"), (3, "Story 3"), (50, "\n".join(f"Paragraph {k}" for k in range(20_000))), (51, "No host")])
    assert got == want


def test_deep_and_unclosed_pages():
    deep = "<div>" * 500 + "Deep" + "<nav>Menu</nav>" + "</div>" * 500
    assert html.main_text(f"<body><div><article><p>First</p>{deep}<p>Last</p></article><p>Side</p></div></body>") == "First\nDeep\nLast\nSide"
    assert html.main_text("<div>" * 100 + "<nav>Menu</nav><article>Deep</article>Side" + "</div>" * 100) == "Deep\nSide"
    assert html.main_text("<html><head><title>T</title><meta charset=utf-8><style>p{}</style><body><p>Words") == "Words"
    assert html.main_text("<head><title>T</title><link rel=x><p>Words<p>More") == "Words\nMore"
    assert html.main_text("<head> <title>T</title> Words <b>more</b></head>") == "Words more"
    assert html.main_text("</div>" * 3 + "<head><title>T</title></head><body>Words</body></html>") == "Words"


def test_language_on_held_out(spark):
    got = queries.op9_language(spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_out_of_place_distance_by_brute_force(spark):
    """Profiles, distances and scores of whole texts in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]

    def grams(text):
        spaced = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        words = [f" {w} " for w in spaced.split()]
        joined = " " + " ".join(spaced.split()) + " " if words else ""
        found = Counter(c for c in joined if c != " ")
        found.update(joined[i : i + 2] for i in range(len(joined) - 1))
        found.update(joined[i : i + 3] for i in range(len(joined) - 2) if joined[i + 1] != " ")
        return found

    # Ties go to the lower code points, shorter n-grams first.
    order = lambda counts, k: sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[:k]
    sums = {}
    for _, t, lang in rows:
        sums.setdefault(lang, Counter()).update(grams(t))
    ranks = {lang: {g: i for i, g in enumerate(order(c, 800))} for lang, c in sums.items()}
    missing = max(map(len, ranks.values()))
    want = {}
    for i, t, _ in rows:
        own = order(grams(t), 400)
        away = sorted((sum(abs(r[g] - k) if g in r else missing for k, g in enumerate(own)), lang) for lang, r in ranks.items())
        want[i] = (away[0][1], 1 - away[0][0] / away[1][0], away[0][0] / missing / len(own))
    got = {r["id"]: tuple(r)[1:] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(np.allclose(got[i][1:], want[i][1:]) for i in want)


def test_language_column_of_very_many_values_is_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 100)
    with pytest.raises(ValueError):
        langid.fit(docs.withColumn("lang", F.col("doc_id").cast("string")))


def test_language_edge_cases(spark, odd):
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert got[1] == got[2] == got[7] == got[8] == ("und", 0.0) and got[5][0] == "de"
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}
    assert langid.predict(odd.limit(0), langid.fit(odd.limit(0))).count() == 0


def test_tokenizer_equals_library(spark, docs, odd):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(model))
    for df in (docs, odd):
        texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = Counter((r["id"], r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.tokenize(df, model, digests=True).collect())
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = Counter((i, len(e := sp.encode(t or "")), h(",".join(map(str, e))), h(sp.decode(e))) for i, t in texts)
        assert got == want


def test_tokenizer_holds_itself_against_the_library(spark, docs, odd, monkeypatch):
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert bpe.mismatches(docs.union(odd.select(docs.columns)), model).count() == 0
    monkeypatch.setattr(bpe.Encoder, "decode", lambda self, ids: "wrong")  # in this process alone, so the tasks below are not touched
    assert bpe.Encoder(bpe.Vocabulary.load(model)).digest("abc")[2] == "wrong"


def test_tokenizer_refuses_other_vocabularies(monkeypatch):
    import sentencepiece

    class Fake:
        def __init__(self, model_file):
            self.kind = model_file

        def get_piece_size(self):
            return 258

        def is_byte(self, i):
            return self.kind == "unigram" and i > 1

        def is_control(self, i):
            return False

        is_unknown = is_control

        def id_to_piece(self, i):
            return f"<0x{i - 2:02X}>" if i > 1 else "ab"[i]

        def get_score(self, i):
            return -1.5

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Fake)
    with pytest.raises(ValueError, match="byte pieces"):
        bpe.Vocabulary.load("no bytes")
    with pytest.raises(ValueError, match="ranks"):
        bpe.Vocabulary.load("unigram")


def test_pipeline_rejects_what_is_in_no_language(spark, docs):
    r = np.random.default_rng(2)
    foreign = ["Это предложение на языке, которого никто не учил.", "これは誰も学んだことのない言語の文です。", " ".join("".join(r.choice(list("bcdfghjkmpqvwxz"), 6)) for _ in range(60))]
    more = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    got = dict(corpus_pipeline.STAGES)["language"](spark, docs.union(more), SMALL)
    assert {x["doc_id"] for x in got.select("doc_id").collect()} == {x["doc_id"] for x in docs.select("doc_id").collect()}


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Every stage takes nulls, empty and long texts, repeats and clashing columns, and an empty table."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:]:
        empty = stage(spark, corpus_pipeline.written(odd.limit(0)), SMALL)
        assert empty.count() == 0 and (name == "tokens" or empty.columns == odd.columns)
        docs = stage(spark, docs, SMALL)
        if name != "tokens":
            docs = corpus_pipeline.written(docs)
            ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
            assert {"line_dedup": {1, 2, 3, 5, 6, 7, 8, 9, None}, "near_dedup": {1, 2, 3, 5, 7, 8, 9, None}, "mixing": {1, 2, 3, 5, 7, 8, 9, None}}[name] == set(ids)
    assert {r["doc_id"]: r["n_tokens"] for r in docs.collect()}[1] == 0
    assert dict(corpus_pipeline.STAGES)["language"](spark, odd.limit(0), SMALL).count() == 0


def test_pipeline_without_a_language(spark, odd):
    """No row names a language: what has letters stays."""
    got = dict(corpus_pipeline.STAGES)["language"](spark, odd.withColumn("lang", F.lit(None).cast("string")), SMALL)
    assert got.columns == odd.columns
    assert sorted((r["doc_id"] or 0 for r in got.collect())) == [0, 3, 3, 4, 5, 6, 9]


def test_pipeline_against_brute_force(spark, docs):
    """Rows of run() are the mix of what the first three stages keep, tokenized; each stage's decisions are checked on its input."""
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, SMALL)
    assert kept.columns == docs.columns and docs.count() - kept.count() <= 0.05 * docs.count()
    lines = stage["line_dedup"](spark, kept, SMALL)
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    holders: dict[str, set] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in rows:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 10 and len(holders[key(x)]) > 1 and i != min(holders[key(x)])
    want = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows}
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(got[i] == want[i] for i in got) and all(not want[i].strip() for i in set(want) - set(got))
    unique = stage["near_dedup"](spark, lines, SMALL)
    root = _jaccard_components(list(got.items()), 5)
    assert {r["doc_id"] for r in unique.collect()} == {i for i in got if root[i] == i}
    mixed = stage["mixing"](spark, unique, SMALL)
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} == {i for i in got if root[i] == i} and mixed.columns == docs.columns
    import sentencepiece

    sp, h = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r["doc_id"], len(e := sp.encode(r["text"])), h(",".join(map(str, e))), h(sp.decode(e))) for r in mixed.collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == want
