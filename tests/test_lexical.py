"""The stored lexical index: scores and ranks against plain BM25, updates against a rebuild, what a search leaves unread."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical

TEXTS = "id long, text string"


def _tokens(text):
    return [w for w in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]


def _bm25(docs, terms):
    """(id, score rounded) by the formula, with the floor for frequent terms."""
    bags = {i: Counter(_tokens(t)) for i, t in docs.items()}
    df = Counter(t for b in bags.values() for t in b)
    n, avgdl = len(bags), sum(b.total() for b in bags.values()) / max(1, len(bags))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {t: 0.25 * mean if w < 0 else w for t, w in raw.items()}
    out = {}
    for i, b in bags.items():
        s = sum(idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * b.total() / avgdl)) for t in terms if b[t])
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return out


def _corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda: " ".join(vocabulary[min(199, int(r.paretovariate(0.6)) - 1)] for _ in range(r.choice([3, 10, 30, 80])))
    return {i: text() for i in range(n)}


def _table(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), TEXTS)


QUERIES = [["w3", "w3", "w40", "w7", "w150", "w0"], ["w0"]]


def _same(ix, docs, k=7):
    """All scores and the best ones of two queries, and a batch of them."""
    tops = {}
    for q, terms in enumerate(QUERIES):
        want = _bm25(docs, terms)
        got = {r["id"]: r["score"] for r in lexical.bm25(ix, terms).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
        tops[q] = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [(r["id"], r["score"]) for r in lexical.bm25_top(ix, QUERIES[0], k).collect()] == tops[0]
    asked = ix.spark.createDataFrame([*enumerate(QUERIES), (8, ["nowhere"]), (9, [])], "query_id int, terms array<string>")
    batch = {q: [] for q in tops}
    for r in lexical.bm25_queries(ix, asked, k).orderBy("query_id", "rank").collect():
        batch[r["query_id"]].append((r["id"], r["score"]))
    assert batch == tops


def test_index_by_plain_bm25_and_read_again(spark, tmp_path):
    docs = _corpus(300, 1) | {300: None, 301: "", 302: "!?"}
    path = str(tmp_path / "ix")
    made = lexical.index(_table(spark, docs), "id", "text", path=path)
    _same(made, docs)
    again = lexical.load_index(spark, path, _table(spark, docs).withColumnRenamed("id", "key"), "key", "text")
    assert (again.n, again.total, again.avg_idf, again.fingerprint) == (made.n, made.total, made.avg_idf, made.fingerprint)
    assert lexical.bm25(again, []).count() == lexical.bm25_top(again, []).count() == 0
    assert {r["id"]: r["text"] for r in lexical.texts_of(again, spark.createDataFrame([(3,), (301,)], "id long")).collect()} == {3: docs[3], 301: ""}
    for stale in (docs | {5: docs[5] + "!"}, {k: v for k, v in docs.items() if k}, docs | {0: docs[1], 1: docs[0]}):
        with pytest.raises(ValueError, match="documents"):
            lexical.load_index(spark, path, _table(spark, stale), "id", "text")


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Documents added, changed, removed, removed and added again, over several segments; then merged."""
    docs = _corpus(200, 2)
    ix = lexical.index(_table(spark, docs), "id", "text", path=str(tmp_path / "ix"))
    new = _corpus(260, 3)
    first = {i: new[i] for i in (0, 5, 17, 210, 211, 212)}
    ix1 = lexical.update(ix, _table(spark, first), spark.createDataFrame([(3,), (4,), (999,)], "id int"))
    docs1 = {i: t for i, t in (docs | first).items() if i not in (3, 4)}
    _same(ix1, docs1)
    ix2 = lexical.update(ix1, _table(spark, {3: "w0 w150 w150", 210: "w199 once"}), spark.createDataFrame([(5,)], "id long"))
    docs2 = {i: t for i, t in (docs1 | {3: "w0 w150 w150", 210: "w199 once"}).items() if i != 5}
    _same(ix2, docs2)
    ix3 = lexical.update(ix2, removed=spark.createDataFrame([(i,) for i in range(0, 200, 2)], TEXTS.split(",")[0]))
    docs3 = {i: t for i, t in docs2.items() if i >= 200 or i % 2}
    _same(ix3, docs3)
    whole = lexical.compact(ix3)
    _same(whole, docs3)
    fresh = lexical.index(_table(spark, docs3), "id", "text")
    for one in (ix3, whole):
        assert (one.n, one.total, one.fingerprint) == (fresh.n, fresh.total, fresh.fingerprint) and abs(one.avg_idf - fresh.avg_idf) < 1e-12
        assert lexical.corpus_stats(one).select("n_docs", "n_terms", "n_floored").first() == lexical.corpus_stats(fresh).select("n_docs", "n_terms", "n_floored").first()
        assert sorted(map(tuple, one.df.collect())) == sorted(map(tuple, fresh.df.collect()))
    assert whole.segments == (4,) and lexical.versions(spark, ix.path) == [0, 1, 2, 3, 4]
    _same(lexical.load_index(spark, ix.path, version=1), docs1)  # readers of an older version go on


def test_sync_finds_what_changed(spark, tmp_path):
    docs = _corpus(120, 4)
    ix = lexical.index(_table(spark, docs), "id", "text", path=str(tmp_path / "ix"))
    assert lexical.sync(ix, _table(spark, docs)).version == 0
    later = {i: t for i, t in (docs | {7: "w1 w2 new", 500: "w150 w0", 501: None}).items() if i not in (1, 2)}
    ix1 = lexical.sync(ix, _table(spark, later))
    _same(ix1, later)
    assert sorted(r["id"] for r in spark.read.parquet(f"{ix.path}/forward/segment=1").collect()) == [7, 500, 501]
    lexical.load_index(spark, ix.path, _table(spark, later))
    _same(lexical.sync(ix1, _table(spark, docs)), docs)


def test_empty_index_fills(spark, tmp_path):
    none = spark.createDataFrame([], TEXTS)
    ix = lexical.index(none, "id", "text", path=str(tmp_path / "ix"))
    assert lexical.bm25(ix, ["w0"]).count() == lexical.bm25_top(ix, ["w0"]).count() == 0
    docs = _corpus(40, 5)
    ix = lexical.sync(ix, _table(spark, docs))
    _same(ix, docs)
    _same(lexical.sync(ix, none), {})


def test_search_leaves_most_blocks_unread(spark, monkeypatch):
    """A rare term beside one that nearly all hold: of the frequent term's blocks few are scored, with the ranks of all."""
    r = random.Random(7)
    docs = {i: " ".join(["the"] * r.choice([1, 2, 3]) + [f"x{r.randrange(900)}" for _ in range(r.choice([5, 20, 60]))] + (["rare"] if i % 997 == 0 else [])) for i in range(20_000)}
    ix = lexical.index(_table(spark, docs), "id", "text")
    every, read = lexical.cell_bounds(ix, ["the", "rare"]).count(), len(lexical.needed_cells(ix, ["the", "rare"], 5))
    assert every > 120 and read < every / 4
    want = sorted(_bm25(docs, ["the", "rare"]).items(), key=lambda x: (-x[1], x[0]))[:5]
    got = [(x["id"], x["score"]) for x in lexical.bm25_top(ix, ["the", "rare"], 5).collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    monkeypatch.setattr(lexical, "NAMED_CELLS", 3)  # as a table
    assert [(x["id"], x["score"]) for x in lexical.bm25_top(ix, ["the", "rare"], 5).collect()] == got
    files = ix.table("postings").where(F.col("bucket") == 0)
    assert max(x["n"] for x in files.where("term = 'the'").collect()) < 20_000 / 100


def test_another_tokenizer(spark):
    docs = {1: "a-b c", 2: "c", 3: "d", 4: "e a b"}
    ix = lexical.index(_table(spark, docs), "id", "text", tokenize=lambda c: F.split(c, " "))
    assert [r["id"] for r in lexical.bm25(ix, ["a-b"]).collect()] == [1]
