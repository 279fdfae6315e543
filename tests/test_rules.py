"""Rules without SQL against brute-force replays, and facts the reference's own tests state."""

import base64
import json
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import labels, lorebook, markdown, text
from quarry.operators import chat, doctree, ingest, mutations, ranking, usage
from quarry.sources import readers, writers
from quarry.streaming import gates


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def hits(spark):
    """Times with bursts and pauses over several days; key 0 holds most rows, one key is null."""
    r = np.random.default_rng(1)
    us = np.cumsum(np.where(r.random(3000) < 0.03, r.integers(60, 90_000, 3000), r.integers(0, 40, 3000)) * 1_000_000)
    key = [None if k == 3 else int(k) for k in np.minimum(r.integers(0, 8, 3000), 3) * (r.random(3000) < 0.5)]
    rows = [(i, k, int(u)) for i, (k, u) in enumerate(zip(key, us))]
    return rows, spark.createDataFrame(rows, "id long, k int, us long").withColumn("ts", F.timestamp_micros("us"))


def test_rate_limit_replay(hits):
    rows, df = hits
    want, state = {}, {}
    for i, k, us in rows:
        q = [t for t in state.get(k, []) if t > us - 60_000_000]
        want[i] = len(q) < 3
        state[k] = q + [us] if want[i] else q
    assert {r["id"]: r["allowed"] for r in gates.rate_limit(df, ["k"], "ts", "id", 3).collect()} == want


def test_rate_limit_facts(spark):
    seconds = [(0, "a", 0.0), (1, "a", 0.1), (2, "a", 0.2), (3, "a", 0.4), (4, "b", 0.5), (5, "a", 61.0)]
    df = spark.createDataFrame([(i, k, int(s * 1e6)) for i, k, s in seconds], "id long, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    out = [r["allowed"] for r in gates.rate_limit(df, ["k"], "ts", "id", 3).orderBy("id").collect()]
    assert out == [True, True, True, False, True, True]
    assert not any(r["allowed"] for r in gates.rate_limit(df, ["k"], "ts", "id", 0).collect())


def test_fixed_anchor_replay(hits):
    rows, df = hits
    want, anchor = {}, {}
    for i, k, us in rows:
        if k not in anchor or us - anchor[k][1] >= 60_000_000:
            anchor[k] = (i, us)
        want[i] = anchor[k][0]
    got = gates.fixed_anchor(df, ["k"], "ts", "id")
    assert {r["id"]: r["anchor_id"] for r in got.collect()} == want


def test_alert_gate_replay(hits):
    rows, df = hits
    want, recent, last = {}, [], {}
    for i, k, us in rows:
        recent = [t for t in recent if us - t < 600_000_000]
        want[i] = len(recent) < 3 and us - last.get(k, -(10**18)) >= 300_000_000
        if want[i]:
            recent.append(us)
            last[k] = us
    assert {r["id"]: r["sent"] for r in gates.alert_gate(df, "k", "ts", "id").collect()} == want


def test_text_facts(spark):
    assert value(spark, text.to_half_width(F.lit("ＡＢＣ１２３，全角！"))) == "ABC123,全角!"
    assert value(spark, text.to_full_width(F.lit("ABC123,全角!"))) == "ＡＢＣ１２３，全角！"
    assert value(spark, text.drop_blank_lines(F.lit("a\n\n\nb\n\n"))) == "a\nb"
    assert value(spark, text.format_text(F.lit('{ "b" :  1, "a": "é" }'), "compress_json"))["text"] == '{"b":1,"a":"é"}'
    assert value(spark, text.format_text(F.lit("{"), "format_json"))["message"] and value(spark, text.format_text(F.lit("x"), "nothing"))["text"] is None
    assert value(spark, F.to_json(text.salvage_json(F.lit('Sure: {"a": [1, 2,],} done')))) == '{"a":[1,2]}'
    assert value(spark, text.masked_key(F.lit("sk-1234567890"))) == "sk-123…7890" and value(spark, text.masked_key(F.lit("short"))) == "*****"
    with pytest.raises(ValueError):
        text.convert_chinese(F.lit("x"), "x2y", {})
    with pytest.raises(LookupError):
        text.convert_chinese(F.lit("x"), "s2t", {})
    assert value(spark, text.convert_chinese(F.lit("龙与书"), "s2t", {"s2t": {"龙": "龍", "书": "書"}})) == "龍与書"


def test_label_facts(spark):
    answers = [value(spark, labels.answered(F.lit(n), F.lit(s))) for n, s in ((3, 0.80), (2, 0.20), (0, 0.0))]
    assert answers == [True, False, False]
    overridden = [value(spark, labels.answered_after_feedback(F.lit(a), F.lit(k))) for a, k in ((True, "unsolved"), (True, "irrelevant"), (False, "solved"))]
    assert overridden == [False, False, True]
    gate = lambda *a: value(spark, labels.quota_gate(*map(F.lit, a)))
    mb = 2**20
    assert [gate(1024 * mb, 1, 1, 0, 0), gate(0, 21 * mb, 1, 0, 0), gate(0, 1, 4, 0, 0), gate(0, 1, 1, 50, 0), gate(0, 1, 1, 0, 5), gate(0, 1, 1, 0, 0)] == ["total", "file", "submit", "user", "ip_day", None]
    assert labels.Tunables.of({"rate_user": "7", "slow_ms": "", "answered_at": "x"}) == labels.Tunables(rate_user=7)


def test_lore_books(spark):
    entry = {"keys": ["龙", "dragon"], "content": "c", "comment": "m", "constant": True, "depth": 4, "secondary_keys": ["x"], "enabled": False}
    wrapped = [[entry], {"entries": [entry, 3]}, {"data": {"character_book": {"entries": {"0": entry}}}}]
    for doc in wrapped:
        got = value(spark, lorebook.to_lore_entries(F.try_parse_json(F.lit(json.dumps(doc)))))
        assert [tuple(e) for e in got] == [("龙, dragon", "c", "m", True, 4, ["x"], False)]
    order = {"entries": {"10": {"key": "c"}, "2": {"key": "b"}, "0": {"key": "a"}}}
    assert [e["key"] for e in value(spark, lorebook.to_lore_entries(F.try_parse_json(F.lit(json.dumps(order)))))] == ["a", "b", "c"]
    there = value(spark, lorebook.convert_book(F.lit(json.dumps({"entries": [entry]})), "characterbook_to_worldbook"))["converted"]
    back = json.loads(value(spark, lorebook.convert_book(F.lit(there), "worldbook_to_characterbook"))["converted"])["entries"][0]
    assert back["keys"] == ["龙", "dragon"] and back["enabled"] is False and back["insertion_order"] == 60 and back["constant"] is True
    assert value(spark, lorebook.convert_book(F.lit('{"entries": []}'), "worldbook_to_characterbook"))["message"] == "no entries found"
    assert "unsupported" in value(spark, lorebook.convert_book(F.lit("{}"), "sideways"))["message"]


def test_chat_prose(spark):
    log = [{"user_name": "unused", "character_name": "unused", "chat_metadata": {}}, {"name": "Me", "is_user": True, "mes": "hi"}, {"name": "Doc", "is_user": False, "mes": "one", "extra": {"reasoning": "why"}}, {"name": "Doc", "is_user": False, "mes": " two "}, {"name": "x", "is_system": True, "mes": "note"}, {"name": "Me", "is_user": True, "mes": "  "}]
    lines = [json.dumps(x) for x in log] + ["not json", ""]
    df = spark.createDataFrame([("a/log - 1.jsonl", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    got = chat.prose(df, include_reasoning=True).first()
    assert got["text"].startswith("# Doc × Me\n\n") and "unused" not in got["text"] and got["text"].count("### Doc") == 1 and "> *思考*：why\n\none\n\ntwo" in got["text"]
    assert (got["n_messages"], got["n_blocks"], got["n_empty"], got["n_bad"]) == (4, 3, 1, 1)


def test_chunks(spark):
    chunks = lambda body: value(spark, markdown.chunk_texts(F.lit(body)))
    assert chunks("short") == [] and chunks(None) == [] and chunks("# a\n" + "x" * 60 + "\n## b\n" + "y" * 60) == ["# a\n" + "x" * 60, "## b\n" + "y" * 60]
    assert [len(c) for c in chunks("\n\n".join(["p" * 900] * 4))] == [1802, 1802] and len(chunks("z" * 5000)) == 1
    # A head that follows too little text stays with it; a short end goes; a deeper head cuts nothing.
    assert chunks("# a\nfew\n# b\n" + "x" * 60 + "\n#### c\n# d") == ["# a\nfew\n# b\n" + "x" * 60 + "\n#### c"]
    assert chunks("p" * 1990 + "\n \n" + "q" * 15 + "\n\n" + "r" * 30) == ["p" * 1990, "q" * 15 + "\n\n" + "r" * 30]


def _plain_chunks(body):
    """Cuts at heads whose distance from the last cut is enough, by copies of the text; then the longest packs of paragraphs, one after the other."""
    cuts = [0]
    for head in (m.start() for m in re.finditer(r"(?m)^#{1,3}[^\S\n]", body)):
        if len(body[cuts[-1] : head].replace("\n", "").strip()) >= 50:
            cuts.append(head)
    pieces = [body[a : b - 1] for a, b in zip(cuts, [*cuts[1:], len(body) + 1])]
    if len(pieces[-1].replace("\n", "").strip()) < 20:
        pieces.pop()
    out = []
    for piece in pieces:
        left = re.split(r"\n\s*\n", piece) if len(piece) > 2000 else []
        out += [] if left else [piece.strip()]
        while left:
            most = next((n for n in range(1, len(left)) if len("\n\n".join(left[:n])) + len(left[n]) > 1800), len(left))
            pack = "\n\n".join(left[:most]).strip()
            out += [pack] if len(pack) >= 20 else []
            left = left[most:]
    return out


def test_chunks_by_plain_cuts():
    r = random.Random(12)
    pieces = ["word ", "w" * 40, "\n", "\n", "\n\n", "\n \t\n", "\n# Head", "\n## ", "\n###\n", "\n#### deep", "\n#no head", " ", "\u3000", "p" * 700, "\n# Next\n"]
    for _ in range(400):
        body = "".join(r.choice(pieces) for _ in range(r.choice([0, 3, 20, 80])))
        assert markdown.chunk_pieces(body, 2000, 1800, 50, 20) == _plain_chunks(body)


def test_a_text_of_very_many_sections_is_walked_once():
    body = "\n".join(f"## Section {i}\n\nSome words of section {i} that say nothing, at some length." for i in range(20_000)) + "\n# x" * 20_000 + "\n\ny" * 20_000
    began = time.time()
    got = markdown.chunk_pieces(body, 2000, 1800, 50, 20)
    assert len(got) > 20_000 and got[7].startswith("## Section 7\n") and time.time() - began < 20


def test_markdown_rules():
    assert markdown.admonitions('!!! warning "T"\n    a\n\n    b\nafter') == "> **⚠️ T**\n>\n> a\n>\n> b\n\nafter"
    assert markdown.admonitions("!!!note\nflat\n!!!\nafter") == "> **📝 Note**\n>\n> flat\n\nafter" and markdown.admonitions("!!!") == "> **📝 提示**"
    assert markdown.containers(":::tip\nx\n:::\ny") == "> **💡 Tip**\n>\n> x\n\ny" and markdown.tabs('=== "A"\n    x') == "**A**\n\nx"
    assert markdown.admonitions("!!! tip\none\n\ntwo\n\n# Head\nx") == "> **💡 Tip**\n>\n> one\n>\n> two\n\n# Head\nx"
    assert markdown.admonitions("??? note\n\n!!! bug Odd one\n\tdeep\nflat") == "> **📝 Note**\n>\n\n> **🐞 Odd one**\n>\n> deep\n\nflat"
    assert markdown.containers("::: callout\nx\n:::") == "> x\n" and markdown.containers(":::danger\nopen") == "> **🚫 Danger**\n>\n> open"
    assert markdown.tabs('x\n=== "A"\n    y\n=== "B"\n    z') == "x\n**A**\n\ny\n\n**B**\n\nz" and markdown.tabs("    x") == "    x"


def test_document_tree(spark):
    page = "---\ntitle: '{t}'\nroute: {r}\norder: {o}\n---\n{b}"
    raw = [page.format(t="Two", r="/a/two/", o=2, b="see [one](one.md#x), [gone](none.md), ![i](one.md), [out](https://e.org/)"), page.format(t="One", r="/a/one/", o=1, b="[up](../A/Two)"), page.format(t="H", r="/verify/x", o="", b="b"), "# Index Probe", "no header"]
    df = spark.createDataFrame([(x,) for x in raw], "text string")
    src = df.select(text.content_hash(F.col("text")).alias("key"), F.when(F.col("text").contains("title: 'Two'"), "a/two.md").otherwise("a/one.md").alias("source_rel"))
    found = doctree.pages(df, src)
    assert {r["reason"]: r["n"] for r in doctree.skip_counts(found).collect()} == {"kept": 2, "probe": 2, "no_route": 1}
    kept = found.where("skip_reason is null")
    nodes = doctree.flatten(doctree.tree(kept))
    assert [r["route"] for r in nodes.orderBy("path_key").collect()] == ["/", "/a/", "/a/one/", "/a/two/"]
    assert {r["route"]: r["synthetic"] for r in nodes.collect()} == {"/": True, "/a/": True, "/a/one/": False, "/a/two/": False}
    body = {r["route"]: r["body"] for r in doctree.index_pages(nodes).collect()}
    assert body["/a/"].endswith("- [One](/a/one/)\n- [Two](/a/two/)\n")
    links = doctree.resolve(doctree.links(kept), kept.select("source_rel", "route"))
    new = {r["source_rel"]: r["body"] for r in doctree.rewrite(kept, links).collect()}
    assert new["a/two.md"] == "see [one](/a/one/#x), gone, ![i](one.md), [out](https://e.org/)" and new["a/one.md"] == "[up](/a/two/)"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    for name, t in (("a.md", "# A"), ("sub/b.md", "b"), ("sub/LICENSE", "x"), ("readme.md", "x"), ("sub/blank.md", " ")):
        (tmp_path / "d" / name).write_text(t)
    assert {r["module"] for r in readers.markdown_tree(spark, str(tmp_path / "d")).collect()} == {"a", "sub/b"}
    card = json.dumps({"name": "龙"})
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"chara\0" + base64.b64encode(card.encode())) + chunk(b"IEND", b"")
    df = spark.createDataFrame([(png,), (b"\x89PNG\r\n\x1a\n",), (None,)], "content binary")
    assert [r["x"] for r in df.select(readers.card_json(F.col("content")).alias("x")).collect()] == [card, None, None]
    raw = spark.createDataFrame([("中文".encode("gbk"),), ("é".encode("utf-8-sig"),), (b"\xff\xff\xff",)], "content binary")
    assert [r["x"] for r in raw.select(readers.decode(F.col("content")).alias("x")).collect()] == ["中文", "é", None]
    path = str(tmp_path / "chunks")
    rows = lambda s, n: spark.createDataFrame([(s, f"{s}{i}") for i in range(n)], "source string, text string")
    writers.replace_by_source(rows("a", 3).union(rows("b", 2)), path)
    writers.replace_by_source(rows("a", 1), path)
    assert {r["source"]: r["count"] for r in spark.read.parquet(path).groupBy("source").count().collect()} == {"a": 1, "b": 2}
    metrics = spark.createDataFrame([("GET", "/a", 200, 2, 10, 0)], "method string, path string, status int, n long, total_ms long, n_slow long")
    assert writers.exposition(metrics).first()["line"] == 'quarry_requests_total{method="GET",path="/a",status="200"} 2'


def test_update_queue(spark, tmp_path):
    kind = "id long, query string, username string, ip string, created_at timestamp_ntz, sources_count int, top_score double, answered boolean, feedback string, feedback_reason string, answer string, sources_digest string, marked boolean"
    digest = json.dumps([{"source": "s", "score": 0.5, "preview": "p"}])
    log = spark.createDataFrame([(1, "why", "", "1.1.1.1", None, 2, 0.25, False, "unsolved", "r", "a\n\nb", digest, True), (2, "x", "u", "i", None, 0, 0.0, None, "", "", "", "", False)], kind)
    got = writers.update_queue(log.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))).collect()
    assert len(got) == 1 and "## [1] why" in got[0]["section"] and "0.250" in got[0]["section"] and "> a\n>\n> b" in got[0]["section"] and "    - [s] 0.5｜p" in got[0]["section"]
    writers.write_queue(log, str(tmp_path / "q"))
    assert spark.read.text(str(tmp_path / "q")).first()["value"] == writers.QUEUE_TITLE


def test_mutations(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(1, 7, "a", "x"), (2, 8, "b", "y")], "id long, user_id long, name string, note string")
    patch = spark.createDataFrame([(1, "z", None, ["note"])], "id long, name string, note string, given array<string>")
    assert [tuple(r) for r in mutations.update(rows, patch).orderBy("id").collect()] == [(1, 7, "a", None), (2, 8, "b", "y")]
    assert mutations.delete(rows, [1, 2], owner=7, admin=False).count() == 1 and mutations.delete(rows, []).count() == 2
    bans = spark.createDataFrame([("1.1.1.1", "old", None, None)], "ip string, reason string, created_at timestamp_ntz, expires_at timestamp_ntz")
    new = spark.createDataFrame([("::ffff:1.1.1.1", "", None), ("127.0.0.1", "no", None), ("2.2.2.2", "r", None)], "ip string, reason string, expires_at timestamp_ntz")
    assert {r["ip"]: r["reason"] for r in mutations.ban_ips(bans, new, now).collect()} == {"1.1.1.1": "old", "2.2.2.2": "r"}


def test_usage_and_ranking(spark):
    rows = spark.createDataFrame([("q", i, "t" * n) for i, n in enumerate((5000, 2500, 700, 10))], "k string, i int, t string")
    assert [len(r["t"]) for r in ranking.context_budget(rows, ["k"], ["i"], "t").orderBy("i").collect()] == [5000, 2500, 500]
    log = spark.createDataFrame([(1, "9.9.9.9", "u"), (2, "9.9.9.9", "v"), (3, "", "w")], "id long, ip string, username string").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = usage.active_ips(log, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).collect()
    assert [(r["ip"], r["n_users"], r["usernames"]) for r in got] == [("9.9.9.9", 2, "u,v")]
    events = spark.createDataFrame([("r", 0, "sources", "[]"), ("r", 2, "token", "b"), ("r", 1, "token", "a"), ("r", 3, "done", None)], "request_id string, ordinal int, type string, data string")
    assert tuple(usage.answers(events).first()) == ("r", "[]", "ab", "done")
    docs = spark.createDataFrame([("d1", "first text"), ("d2", "first text")], "file string, text string")
    cache = spark.createDataFrame([], "key string, translated string")
    out, new = ingest.translate(docs, cache, F.concat(F.col("text"), F.lit(" in translation")))
    assert new.count() == 1 and {r["text"] for r in out.collect()} == {"first text in translation"}
