"""Segmentation by a dictionary and phrase conversion, against brute force."""

import random
from itertools import combinations
from math import log

import pytest
from pyspark.sql import functions as F

from quarry.functions import segment, text
from quarry.operators import lexical


def _best(run, words):
    """The best sum of weights over all ways to cut a run."""
    lexicon = segment.Lexicon(words)
    every = []
    for n in range(len(run)):
        for cuts in combinations(range(1, len(run)), n):
            parts = [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]
            if all(p in words or len(p) == 1 for p in parts):
                every.append((sum(lexicon.weight.get(p, lexicon.unknown) for p in parts), parts))
    return max(every)[0], lexicon


@pytest.mark.parametrize("seed", range(40))
def test_best_path_by_brute_force(seed):
    r = random.Random(seed)
    words = {"".join(r.choice("世界书的龙a") for _ in range(r.choice([1, 2, 2, 3, 4]))): r.choice([0, 1, 5, 80, 1000]) for _ in range(12)}
    run = "".join(r.choice("世界书的龙a未") for _ in range(r.choice([1, 5, 10])))
    want, lexicon = _best(run, words)
    got = lexicon.path(run)
    assert "".join(got) == run and abs(sum(lexicon.weight.get(p, lexicon.unknown) for p in got) - want) < 1e-9


def test_words_and_unknown_runs():
    lexicon = segment.Lexicon({"世界书": 50, "世界": 60, "书": 40, "递归": 30, "扫描": 30, "的": 900})
    assert lexicon.words("世界书的递归扫描") == ["世界书", "的", "递归", "扫描"]
    assert lexicon.words("用GPT4读世界书, v2.5!\n") == ["用", "gpt4", "读", "世界书", "v2", "5"]
    assert lexicon.words(None) == lexicon.words(" ,。") == [] and segment.Lexicon({}).words("漢字abc") == ["漢", "字", "abc"]
    assert abs(lexicon.weight["的"] - (log(900) - log(1110))) < 1e-12
    assert len(segment.Lexicon({"ab": 1}).words("ab" * 200_000)) == 200_000


def test_index_with_a_dictionary_finds_words_inside_sentences(spark):
    docs = spark.createDataFrame([(1, "世界书的递归扫描很慢"), (2, "角色卡的导入"), (3, None), (4, "世界很大")], "id long, text string")
    cut = segment.tokenizer(spark, {"世界书": 50, "世界": 60, "递归": 30, "扫描": 30, "角色卡": 20, "导入": 9, "的": 900, "很": 300})
    ix = lexical.index(docs, "id", "text", tokenize=cut)
    assert [r["id"] for r in lexical.bm25_top(ix, ["递归", "世界书"]).collect()] == [1]
    assert lexical.bm25(lexical.index(docs, "id", "text"), ["递归"]).count() == 0  # runs of letters are whole sentences
    now = lexical.update(ix, spark.createDataFrame([(2, "递归")], "id long, text string"))
    assert {r["id"] for r in lexical.bm25(now, ["递归"]).collect()} <= {1, 2} and now.df.where("term = '递归'").first()["df"] == 2


def test_phrases_override_characters_and_tables_follow_one_another(spark):
    tables = {"s2t": {"发": "發", "头": "頭", "头发": "頭髮", "后": "後", "皇后": "皇后", "干": "乾"}, "s2tw": [{"里": "裡", "软件": "軟體"}, {"軟體": "軟體(1)", "台": "臺"}], "s2hk": {}}
    rows = spark.createDataFrame([(0, "头发发皇后后头"), (1, None), (2, ""), (3, "x头"), (4, "里软件台软")], "id int, t string")
    of = lambda d: [r["x"] for r in rows.orderBy("id").select(text.convert_chinese(F.col("t"), d, tables).alias("x")).collect()]
    assert of("s2t") == ["頭髮發皇后後頭", None, "", "x頭", "里软件台软"]
    assert of("s2tw")[4] == "裡軟體(1)臺软" and of("s2hk")[0] == "头发发皇后后头"
    r = random.Random(3)
    table = {"".join(r.choice("abc") for _ in range(r.choice([1, 2, 3]))): r.choice(["X", "", "yz"]) for _ in range(9)}
    convert = segment._longest(table)
    for _ in range(200):
        t = "".join(r.choice("abcd") for _ in range(12))
        want, i = "", 0
        while i < len(t):
            fit = max((k for k in table if t.startswith(k, i)), key=len, default=None)
            want, i = (want + table[fit], i + len(fit)) if fit else (want + t[i], i + 1)
        assert convert(t) == want
