"""Resampling, lexical search and decontamination against brute force on small tables, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, lexical, mixing, queries, resampling, sharding
from quarry.llm.common import from_files, placed

DOCS = "doc_id long, text string, row string, id string, items array<string>, place int, block long, term string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd():
    """Null and empty texts, null ids, repeats, ties, a very long text, letters beyond ASCII, few words drawn often."""
    r = random.Random(5)
    vocabulary = ["alpha", "Beta", "gámma", "δ", "e5", "zeta", "eta", "theta", "İota", "kappa", "漢字", "mu"]
    line = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "!", ",\n", "\x00"]) for _ in range(n))
    rows = [(i, line(r.choice([1, 3, 12, 40, 90]))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n!"), (None, line(30)), (None, line(30)), (63, rows[4][1]), (4, rows[4][1]), (4, rows[4][1]), (64, line(60_000)), (65, "WORT Straße ÄBİ")]
    return rows


@pytest.fixture(scope="module")
def asked(odd):
    r = random.Random(6)
    parts = [w for w in (_words(t) for _, t in odd) if len(w) > 30]
    items = [(i, " ".join(w[k : k + 25])) for i, (w, k) in enumerate((r.choice(parts), r.randrange(5)) for _ in range(12))]
    items += [(12, "Alpha beta"), (13, None), (14, " "), (None, "kappa MU mu"), (15, items[3][1]), (16, "nowhere else found words here at all in any of these texts no"), (17, "alpha alpha alpha"), (11, "e5 e5 δ")]
    return items


def _frame(spark, odd):
    return spark.createDataFrame([(*x, "r", "i", ["x"], 1, 2, "t") for x in odd], DOCS)


def _items(spark, asked):
    return spark.createDataFrame(asked, "item_id long, text string")


def _hits(odd, asked, size=10):
    out = []
    for doc_id, text in odd:
        w, hit, names = _words(text), set(), set()
        for item, t in asked:
            v = _words(t)
            k = min(size, len(v))
            if not k:
                continue
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    names |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), sorted(hit), sorted(names)))
    return out


@pytest.mark.parametrize("shard,block", [(8 << 20, 4 << 20), (2_000, 40)])
def test_decontamination_by_brute_force(spark, odd, asked, monkeypatch, shard, block):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    got = decontaminate.hits(_frame(spark, odd), _items(spark, asked), carry=True).withColumn("n_hit", decontaminate.n_hit()).collect()
    mine = [(g["id"], g["n_words"], sorted(i for s in g["spans"] for i in range(s["start"], s["end"])), g["items"]) for g in got]
    assert sorted(mine, key=repr) == sorted(_hits(odd, asked), key=repr)
    assert all(g["n_hit"] == sum(s["end"] - s["start"] for s in g["spans"]) and g["row"]["items"] == ["x"] for g in got)
    clean = decontaminate.clean(_frame(spark, odd), _items(spark, asked))
    assert clean.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == sorted(d or -1 for d, _, hit, _ in _hits(odd, asked) if not hit)


def test_decontamination_of_empty_tables(spark, odd, asked):
    docs, items = _frame(spark, odd), _items(spark, asked)
    assert decontaminate.hits(docs.limit(0), items).collect() == []
    assert {(r["n_words"] >= 0, tuple(r["spans"]), tuple(r["items"])) for r in decontaminate.hits(docs, items.limit(0)).collect()} == {(True, (), ())}
    assert decontaminate.longest_matches(docs, items.limit(0)).collect() == []


def test_longest_matches_by_brute_force(spark, odd, asked, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 3_000)
    texts = [(i, _words(t)) for i, t in odd if i is not None and len(t or "") < 10_000]
    docs = spark.createDataFrame([x for x in odd if x[0] is not None and len(x[1] or "") < 10_000], "doc_id long, text string")
    items = [x for x in asked if x[0] not in (None, 11)]
    got = {(r["item"], r["item_at"]): r for r in decontaminate.longest_matches(docs, _items(spark, items), least=3).collect()}
    of = {}
    for i, w in texts:
        of.setdefault(i, []).append(w)
    for item, t in items:
        v = _words(t)
        for at in range(len(v)):
            best = 0
            for _, w in texts:
                for i in range(len(w)):
                    n = 0
                    while at + n < len(v) and i + n < len(w) and w[i + n] == v[at + n]:
                        n += 1
                    best = max(best, n)
            found = got.pop((str(item), at), None)
            assert (found["length"] if found else 0) == (best if best >= 3 else 0)
            assert not found or any(w[found["at"] : found["at"] + best] == v[at : at + best] for w in of[found["id"]])
    assert not got


def _resampled(odd, asked):
    grams = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    buckets = lambda t: Counter(zlib.crc32(g.encode()) % 10_000 for g in grams(_words(t)))
    s = sum((buckets(t) for _, t in odd), Counter())
    t = sum((buckets(x) for _, x in asked), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    rows = []
    for i, text in odd:
        f = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[b] for b, n in f.items())
        rows.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(_words(text))])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    return rows, fit


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resampling_by_brute_force(spark, odd, asked, percent):
    rows, fit = _resampled(odd, asked)
    for n, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = n
    got = resampling.resample(_frame(spark, odd), _items(spark, asked), percent=percent).collect()
    mine = [(g["id"], g["n_features"], g["weight"], g["score"], g["rank"], g["n_words"]) for g in got]
    assert sorted(mine, key=repr) == sorted(map(tuple, rows), key=repr)


def test_resampling_of_empty_tables(spark, odd, asked):
    docs, items = _frame(spark, odd), _items(spark, asked)
    assert resampling.resample(docs.limit(0), items).collect() == []
    assert resampling.resample(docs, items.limit(0)).count() == len(odd)
    assert resampling.resample(docs.where("false"), items.limit(0)).collect() == []


def test_resampling_is_native(spark, odd, asked, tmp_path):
    _frame(spark, odd).write.parquet(str(tmp_path / "d"))
    out = resampling.scores(spark.read.parquet(str(tmp_path / "d")), _items(spark, asked))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan.split("Scan")[1]


def _ranked(odd, asked, k=10):
    bags = [(i, Counter(_words(t))) for i, t in odd]
    n, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in asked:
        scores = []
        for i, b in bags:
            m = 25 + (75 * b.total() * n) // max(1, total)
            scores.append((sum(weight[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in _words(text) if b[t]), i))
        best = sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], -1 if x[1] is None else x[1]))[:k]
        out += [(item, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block,batch,lookups,only", [(16 << 20, 1 << 20, 1 << 20, True), (1_500, 60, 0, False), (300, 1 << 20, 1 << 20, True)])
def test_lexical_search_by_brute_force(spark, odd, asked, monkeypatch, block, batch, lookups, only):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "BATCH_WORDS", batch)
    monkeypatch.setattr(lexical, "BROADCAST_LOOKUPS", lookups)
    items = _items(spark, asked)
    terms = lexical.distinct_terms(items)
    assert set(terms.to_pylist()) == {w for _, t in asked for w in _words(t)} and lexical.distinct_terms(items, most=3) is None
    ix = lexical.index(_frame(spark, odd), terms=terms if only else None)
    got = [tuple(r) for r in lexical.search(ix, items).collect()]
    assert sorted(got, key=repr) == sorted(_ranked(odd, asked), key=repr)


def test_thresholds_leave_postings_unfetched(spark, monkeypatch):
    """Rare words decide: lists of frequent words are cut, and the ranks are those of all postings."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(30)]
    odd = [(i, " ".join([r.choice(common) for _ in range(r.choice([20, 60]))] + ([f"rare{j}" for j in range(12)] if i % 19 == 0 else []))) for i in range(400)]
    asked = [(0, " ".join([f"rare{j}" for j in range(12)])), (1, "c1 c2 " + " ".join(f"rare{j}" for j in range(12)))]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2_000)
    ix = lexical.index(spark.createDataFrame(odd, "doc_id long, text string"))
    cuts = {}
    known = lexical._accumulate

    def watched(k, asked, bounds, n):
        cuts.update({t: v[2] for t, v in asked.value[0].items()})
        return known(k, asked, bounds, n)

    monkeypatch.setattr(lexical, "_accumulate", watched)
    got = [tuple(r) for r in lexical.search(ix, _items(spark, asked), k=3).collect()]
    assert sorted(got) == sorted(_ranked(odd, asked, 3))
    tops = {r["term"]: r["t"] for r in ix.segments.groupBy("term").agg(F.max("top").alias("t")).collect()}
    assert cuts["c1"] > 1 and any(cuts[t] > tops[t] * 0.5 for t in cuts)


def test_lexical_search_of_empty_tables(spark, odd, asked):
    docs, items = _frame(spark, odd), _items(spark, asked)
    assert lexical.search(lexical.index(docs.limit(0)), items).collect() == []
    assert lexical.search(lexical.index(docs), items.limit(0)).collect() == []
    assert lexical.search(lexical.index(docs, terms=pa.array([], pa.string())), items).collect() == []


def test_places_are_unique(spark, tmp_path):
    """A partitioned table has one file name in several folders; two folders read together and one folder read twice have it, too."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"), (F.col("id") % 4).alias("source")).coalesce(1)
    rows.write.partitionBy("source").parquet(str(tmp_path / "a"))
    rows.write.parquet(str(tmp_path / "b"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for docs, n in ((spark.read.parquet(a), 40), (spark.read.parquet(b, b), 80), (spark.read.option("basePath", a).parquet(f"{a}/source=1", f"{a}/source=2"), 20), (spark.read.parquet(a).union(spark.read.parquet(a)), 80)):
        assert from_files(docs).count() == n
        got = placed(docs).select("_at").collect()
        assert len(got) == n and len({tuple(r["_at"]) for r in got}) == n


def test_mixing_and_sharding_of_partitioned_and_repeated_files(spark, tmp_path):
    """One file name in several folders, and a folder read twice: each placement carries its own row, and every row has one slot."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("same text of "), F.col("id") % 3).alias("text"), (F.col("id") % 4).cast("string").alias("source")).coalesce(1)
    rows.write.partitionBy("source").parquet(str(tmp_path / "a"))
    rows.write.parquet(str(tmp_path / "b"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for docs, copies in ((spark.read.parquet(a), 1), (spark.read.parquet(b, b), 2)):
        out = mixing.mix(docs, carry=["doc_id", "text"], stored=True).select("id", "row.*").collect()
        assert all(r["id"] == r["doc_id"] and r["text"] == f"same text of {r['id'] % 3}" for r in out)
        assert sorted(r["id"] for r in out) == sorted([*range(40)] * copies)
        dealt = [sorted((r["shard"], r["slot"], r["row"]["doc_id"]) for r in sharding.shard(docs, 7, bucket_bytes=200).collect()) for _ in range(2)]
        assert (copies == 2 or dealt[0] == dealt[1]) and sorted(i for _, _, i in dealt[0]) == sorted([*range(40)] * copies)
        for shard in range(7):
            slots = [slot for s, slot, _ in dealt[0] if s == shard]
            assert slots == list(range(len(slots))) and len(slots) in (40 * copies // 7, 40 * copies // 7 + 1)


def test_registered(spark):
    assert {"op11_resampling", "op12_lexical", "op13_decontaminate"} <= set(queries.QUERIES) & set(queries.SQL)
