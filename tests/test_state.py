"""Operators that change stored tables or the knowledge base, and small rules, against facts worked out by hand."""

import json
import random
import threading
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry.functions import labels, lorebook, markdown, text
from quarry.operators import doctree, ingest, knowledge, lexical, mutations, quotas, retrieval, usage
from quarry.sources import readers, scratch, writers
from quarry.streaming import gates

DAY = "2024-01-{:02d} 00:00:00"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(day):
    return F.lit(DAY.format(day)).cast("timestamp_ntz")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_changes_of_one_row_in_a_batch_dont_double_it(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    patch = spark.createDataFrame([(1, "x", ["name"], 5), (1, "y", ["name"], 9), (1, "z", ["name"], 7)], "id long, name string, given array<string>, seq int")
    assert rows(mutations.update(table, patch, at="seq"), "id") == [(1, "y"), (2, "b")]
    kind = "id long, answered boolean, feedback string, feedback_reason string, feedback_at timestamp_ntz"
    log = spark.createDataFrame([(1, True, "", "", None), (2, None, "", "", None)], kind)
    ratings = spark.createDataFrame([(1, "solved", "", 1), (1, "irrelevant", "r" * 300, 2)], "id long, kind string, reason string, seq int")
    got = mutations.rate(log, ratings, at(3), at="seq").orderBy("id").collect()
    assert len(got) == 2 and (got[0]["answered"], got[0]["feedback"], len(got[0]["feedback_reason"])) == (False, "irrelevant", 255) and got[1]["answered"] is None
    bans = spark.createDataFrame([], "ip string, reason string, created_at timestamp_ntz, expires_at timestamp_ntz")
    new = spark.createDataFrame([("1.1.1.1", "a", None, 1), ("::ffff:1.1.1.1", "b", None, 2)], "ip string, reason string, expires_at timestamp_ntz, seq int")
    assert [(r["ip"], r["reason"]) for r in mutations.ban_ips(bans, new, at(1), at="seq").collect()] == [("1.1.1.1", "b")]


def test_appends_and_their_cuts(spark):
    cards = spark.createDataFrame([(1, 7, "a", "")], "id long, user_id long, name string, image_path string")
    new = spark.createDataFrame([(2, 8, "b" * 20)], "id long, user_id long, name string")
    assert rows(mutations.append(cards, new.withColumn("image_path", F.lit("")), {"name": 5}), "id")[1] == (2, 8, "bbbbb", "")
    logins = spark.createDataFrame([], "id long, user_agent string, action string")
    more = spark.createDataFrame([(1, "u" * 300, "a" * 20)], "id long, user_agent string, action string")
    assert [(len(r[1]), len(r[2])) for r in rows(mutations.append(logins, more, {"user_agent": 255, "action": 16}), "id")] == [(255, 16)]
    kind = "content string, category string"
    feedback = spark.createDataFrame([("  ", "故障"), (" x ", "odd"), (None, None), ("y" * 5000, "建议")], kind)
    got = mutations.feedback_rows(feedback, at(1)).collect()
    assert [(len(r["content"]), r["category"], r["handled"]) for r in got] == [(1, "其他", False), (4000, "建议", False)]


def test_marks_handling_and_clearing(spark):
    log = spark.createDataFrame([(1, True, False, None), (2, False, True, None), (3, None, False, None)], "id long, answered boolean, marked boolean, marked_at timestamp_ntz")
    assert [(r[2], r[3] is not None) for r in rows(mutations.mark(log, [1, 9], True, at(2)), "id")] == [(True, True), (True, False), (False, False)]
    assert [r[2] for r in rows(mutations.mark(log, [2], False, at(2)), "id")] == [False, False, False] and rows(mutations.mark(log, [], True, at(2)), "id") == rows(log, "id")
    assert [r[0] for r in rows(mutations.clear_log(log, True), "id")] == [1, 3] and mutations.clear_log(log, False).count() == 0
    feedback = spark.createDataFrame([(1, False, None, ""), (2, False, None, "")], "id long, handled boolean, handled_at timestamp_ntz, handled_by string")
    done = mutations.handle(feedback, 2, True, "boss", at(2))
    assert [(r[1], r[3]) for r in rows(done, "id")] == [(False, ""), (True, "boss")]
    assert [(r[1], r[2], r[3]) for r in rows(mutations.handle(done, 2, False, "boss", at(3)), "id")][1] == (False, None, "")


def test_users_and_sessions(spark):
    users = spark.createDataFrame([(3, True, "", None, None), (5, True, "", None, None)], "id long, is_active boolean, ban_reason string, banned_at timestamp_ntz, is_admin boolean")
    sessions = spark.createDataFrame([(3, "a"), (5, "b"), (5, "c")], "user_id long, token string").withColumn("expires_at", F.when(F.col("token") == "a", at(1)).otherwise(at(9)))
    banned, left, kicked = mutations.ban_user(users, sessions, 5, "r" * 300, at(2))
    assert [(r[1], len(r[2])) for r in rows(banned, "id")] == [(True, 0), (False, 255)] and [r[1] for r in rows(left, "token")] == ["a"] and kicked.first()[0] == 2
    assert [(r[1], r[2], r[3]) for r in rows(mutations.unban_user(banned, 5), "id")][1] == (True, "", None)
    assert [r[4] for r in rows(mutations.first_user_is_admin(users), "id")] == [True, False]
    assert [r[1] for r in rows(mutations.drop_expired(sessions, at(5)), "token")] == ["b", "c"]


def test_attachments(spark):
    files = spark.createDataFrame([(i, 7 if i != 2 else 8, None if i != 3 else 99, "f") for i in range(1, 13)], "id long, user_id long, ref_id long, orig_name string").withColumn("source", F.lit(""))
    bound = mutations.bind_attachments(files, list(range(1, 13)), 7, "query", 5)
    assert [r[0] for r in rows(bound.where("ref_id = 5"), "id")] == [1, 4, 5, 6, 7, 8, 9, 10]
    log = spark.createDataFrame([(5, "solved"), (6, ""), (99, "unsolved")], "id long, feedback string")
    got = {r["id"]: [f["id"] for f in r["files"]] for r in usage.log_with_attachments(log, bound).collect()}
    assert got == {5: [1, 4, 5, 6, 7, 8, 9, 10], 6: [], 99: []}
    assert mutations.delete(files.where("ref_id is null"), [1, 2], owner=7, admin=False, only=F.col("ref_id").isNull()).count() == 10
    assert [value(spark, labels.file_type(F.lit(x))) for x in ("a.PDF", "b.exe", "c")] == ["application/pdf", None, None]


def test_request_rules(spark):
    paths = ["/api/auth/login", "/api/rag/ask", "/api/rag/search", "/api/items", "/api/auth/me"]
    assert [value(spark, labels.rate_bucket(F.lit(p))) for p in paths] == ["auth", "heavy", "heavy", None, None]
    tiers = [value(spark, labels.rate_cap(F.lit(b), F.lit(s))) for b, s in (("auth", True), ("heavy", True), ("heavy", False))]
    assert tiers == [10, 50, 30]
    assert [value(spark, labels.owner_or_admin(F.lit(o), F.lit(7), F.lit(a))) for o, a in ((7, False), (8, False), (8, True), (None, None))] == [True, False, True, False]
    rate = lambda *a: value(spark, labels.may_rate(*map(F.lit, a)))
    assert [rate(7, "1.1.1.1", 7, "2.2.2.2"), rate(8, "1.1.1.1", 7, "::ffff:1.1.1.1"), rate(8, "", 7, ""), rate(None, None, 7, "x")] == [True, True, False, False]
    assert value(spark, labels.tag_summary(F.array(*[F.lit(str(i)) for i in range(9)]))) == "0、1、2、3、4、5" and value(spark, labels.tag_summary(F.lit(None).cast("array<string>"), F.lit("x" * 90))) == "x" * 80
    errors = spark.createDataFrame([(i, "s", "k", f"m{i % 25}" + "z" * 3000, "p") for i in range(60)], "id long, session string, kind string, message string, page string").withColumn("created_at", at(1))
    sent = usage.client_errors(errors).collect()
    assert len(sent) == 20 and {r["id"] for r in sent} == set(range(20)) and max(len(r["message"]) for r in sent) == 2000


def test_null_keys_and_large_keys_in_replays(spark):
    big = 2**60 + 1
    hits = spark.createDataFrame([(1, None, None), (2, "None", big), (3, None, None), (4, "None", big + 1)], "id long, k string, n long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = gates.rate_limit(hits, ["k", "n"], "ts", "id", 1)
    assert {r["id"]: (r["n"], r["allowed"]) for r in got.collect()} == {1: (None, True), 2: (big, True), 3: (None, False), 4: (big + 1, True)}


def test_merged_log(spark):
    log = spark.createDataFrame([(1, 0, 0.1, False, ""), (2, 3, 0.9, True, "A"), (3, 1, 0.5, True, ""), (4, 2, 0.2, False, "B")], "id long, sources_count int, top_score double, answered boolean, answer string").withColumn("repeat_count", F.lit(1).cast("long"))
    anchors = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 1, 30), (4, 4, 99)], "id long, anchor_id long, us long")
    got = {r["id"]: (r["repeat_count"], r["sources_count"], r["top_score"], r["answered"], r["answer"]) for r in gates.merged_log(log, anchors).collect()}
    assert got == {1: (3, 1, 0.5, True, "A"), 4: (1, 2, 0.2, False, "B")}


def test_files_and_caches(spark, tmp_path):
    (tmp_path / "t/topic").mkdir(parents=True)
    (tmp_path / "t/topic/a.txt").write_text("  text a\n")
    (tmp_path / "t/topic/blank.txt").write_text(" \n")
    chunks = readers.text_chunks(spark, str(tmp_path / "t"))
    assert rows(chunks, "path") == [("topic/a.txt", "topic", "text a")]
    assert ingest.whole_files(chunks, "path").first()["source"] == "files_topic_" + value(spark, text.content_hash(F.lit("text a")))[:8]
    one = spark.createDataFrame([("intro\n## 标题 One!\n" + "x" * 60 + "\n## b\nshort",)], "text string")
    got = ingest.split_sections(one).collect()
    assert [(r["topic"], r["source"][:21]) for r in got] == [("标题 One!", "sections_标题_One__" + got[0]["chunk_hash"][:4])] or got[0]["source"].startswith("sections_标题_One__")
    both = ingest.union_families(chunks.select("path", "text"), one)
    assert both.columns == ["path", "text"] and both.count() == 2
    for name, doc in (("flat", {"__commit__": "c1", "k": "v"}), ("nested", {"__commit__": "c1", "translations": {"k": "v"}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        assert rows(readers.translation_cache(spark, str(tmp_path / f"{name}.json")), "key") == [("c1", "k", "v")]
        assert rows(readers.indexed_hashes(spark, str(tmp_path / f"{name}.json")), "md5") == [("k", "c1")]
    writers.append_cache(spark.createDataFrame([("k2", "v2")], "key string, translated string"), str(tmp_path / "cache"))
    writers.append_cache(spark.createDataFrame([("k3", "v3")], "key string, translated string"), str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    docs = spark.createDataFrame([(True,), (False,)], "translated_ok boolean")
    assert ingest.next_version("a", "b", docs) == "a" and ingest.next_version("a", "b", docs.where("translated_ok")) == "b"
    writers.write_version(spark, str(tmp_path / "version"), "b")
    assert spark.read.parquet(str(tmp_path / "version")).first()[0] == "b"
    writers.ndjson(spark.createDataFrame([(1, None), (2, "x")], "id long, note string").coalesce(1), str(tmp_path / "nd"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "nd")).collect()] == [{"id": 1}, {"id": 2, "note": "x"}]
    with pytest.raises(FileNotFoundError, match="no manifest"):
        readers.manifest(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="corrupt"):
        readers.manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "good.json").write_text(json.dumps({"flat": [{"route": "/a/", "title": "A", "path": "a.md", "hasPage": True, "synthetic": False, "sourceRel": "a.md"}]}))
    assert rows(readers.manifest(spark, str(tmp_path / "good.json")), "route") == [("/a/", "A", "a.md", True, False, "a.md")]
    assert [value(spark, text.embedding_input(F.lit(x))) for x in (" \t", " a ", None)] == ["空", "a", "空"] and len(value(spark, text.embedding_input(F.lit("y" * 7000)))) == 6000


def test_running_numbers(spark):
    some = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("t")).repartition(7)
    assert all(r["k"] == r["number"] for r in ingest.numbered(some, ["k"]).collect()) and ingest.numbered(some.limit(0), ["k"]).count() == 0


def test_scratch_tables_are_removed(spark):
    with scratch.scope() as outer:
        other = scratch.stored(spark.range(2))
        with scratch.scope() as made:
            kept = scratch.stored(spark.range(3))
        (path,) = made
        assert kept.count() == 3 and outer[1:] == [path]
        scratch.remove(spark, made)
    assert len(outer) == 1 and other.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_scratch_scopes_of_threads_are_apart(spark):
    """What another thread stores in the meantime is in no other scope."""
    stored, inside = threading.Event(), threading.Event()
    found = {}

    def other():
        inside.wait(60)
        with scratch.scope() as made:
            found["df"], found["made"] = scratch.stored(spark.range(5)), list(made)
        stored.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch.scope() as made:
        inside.set()
        assert stored.wait(120)
        scratch.stored(spark.range(1))
    thread.join()
    assert len(made) == len(found["made"]) == 1 and made != found["made"]
    scratch.remove(spark, made)
    assert found["df"].count() == 5


def test_tree_pages(spark, tmp_path):
    assert [value(spark, doctree.route_path(F.lit(r))) for r in ("/", "/a/b/", "a")] == ["index.md", "a/b.md", "a.md"] and value(spark, doctree.depth(F.lit("/a/b/"))) == 2
    found = spark.createDataFrame([("/b/", "B", 2), ("/a/x/", "X", None), ("/c/", "C", 1)], "route string, title string, ord int").withColumn("icon", F.lit(""))
    nodes = doctree.tree(found)
    asked = spark.createDataFrame([("c",), ("/a/x",), ("/nope",), ("",)], "route string")
    assert {r["asked"]: (r["title"], r["top_level"]) for r in doctree.article(nodes, asked).collect()} == {"c": ("C", True), "/a/x": ("X", False), "/nope": (None, None), "": (doctree.ROOT_TITLE, True)}
    placed = doctree.intervals(nodes)
    parts = doctree.nested_parts(placed).orderBy("enter").collect()
    tree = json.loads("".join(r["part"] for r in parts))
    assert tree["route"] == "/" and [c["route"] for c in tree["children"]] == ["/c/", "/b/", "/a/"] and tree["children"][2]["children"][0]["title"] == "X" and tree["children"][2]["synthetic"]
    assert len(parts) == nodes.count() and doctree.nested_parts(doctree.intervals(nodes.limit(0))).count() == 0
    assert {r["route"]: (r["enter"], r["leave"]) for r in placed.collect()} == {"/": (0, 4), "/c/": (1, 1), "/b/": (2, 2), "/a/": (3, 4), "/a/x/": (4, 4)}
    assert sorted(r["route"] for r in doctree.subtree(placed, "a").collect()) == ["/a/", "/a/x/"] and doctree.subtree(placed, "/nope/").count() == 0
    kids = {r["route"]: [c["route"] for c in r["children"]] for r in doctree.children_lists(nodes).collect()}
    assert kids == {"/": ["/c/", "/b/", "/a/"], "/a/": ["/a/x/"]}
    listed, disk = (spark.createDataFrame([(p,) for p in ps], "path string") for ps in (("a", "b"), ("b", "c")))
    assert rows(doctree.consistency(listed, disk), "path") == [("a", "missing"), ("c", "unlisted")]
    print_ = spark.createDataFrame([("f1",)], "fingerprint string")
    made = spark.createDataFrame([("f1", "c1")], "fingerprint string, commit string")
    status = lambda *a, **k: doctree.staleness(made, *a, **k).first()[0]
    assert [status(print_, "c1"), status(print_, "c2"), status(print_.where("false"), "c1"), status(print_, "c1", force=True)] == ["current", "stale", "stale", "stale"]
    full = nodes.select("route", "title", doctree.route_path(F.col("route")).alias("path"), F.lit(True).alias("has_page"), "synthetic")
    writers.manifest(full, str(tmp_path / "m"), "c1", print_)
    head = spark.read.json(str(tmp_path / "m/head")).first()
    assert (head["pages"], head["articles"], head["commit"], head["fingerprint"]) == (5, 3, "c1", "f1") and spark.read.json(str(tmp_path / "m/flat")).count() == 5


def test_links_with_brackets(spark):
    bodies = spark.createDataFrame([("a.md", "[x](b_(c).md#s) [![i](p.png)](b_(c).md) [](e.md) [t](u v)")], "source_rel string, body string")
    assert [(r["text"], r["target"], r["anchor"]) for r in doctree.links(bodies).collect()] == [("x", "b_(c).md", "#s")]
    assert value(spark, markdown.image_count(F.lit("![a](b(c)) ![](x) [n](y)"))) == 2


def test_generated_cards_and_books(spark):
    card = lambda x: value(spark, lorebook.card_defaults(F.try_parse_json(F.lit(json.dumps(x))))).asDict()
    assert card({"name": "n"}) == {"tags": [], "custom_css": "", "has_status_bar": False, "status_bar_content": "", "image_path": ""}
    assert card({"tags": "a, b", "has_status_bar": True})["tags"] == ["a", "b"] and card({"tags": ["x"], "custom_css": "c"})["custom_css"] == "c"
    book = value(spark, F.to_json(lorebook.book_defaults(F.try_parse_json(F.lit(json.dumps({"entries": [{"key": "k"}, {"depth": 4, "comment": "c", "trigger_words": ["w"]}]}))))))
    got = json.loads(book)
    assert got["tags"] == [] and [(e["depth"], e["comment"], e["trigger_words"]) for e in got["entries"]] == [(1, "", []), (4, "c", ["w"])]


def test_results_with_metadata_neighbours_and_routes(spark):
    hits = spark.createDataFrame([(1, "h1", 1), (2, "h2", 2), (3, "h3", 3), (4, "h4", 4)], "id long, h string, ord int")
    metas = spark.createDataFrame([("h1", 1, "s", "m1", "en", "a.md"), ("h1", 2, None, None, None, "b.md"), ("h2", 1, "s", "a.md", "zh", "gone.md"), ("h4", 1, "s", "", "zh", None)], "h string, ord int, source string, module string, language string, source_file string")
    named = retrieval.with_metadata(hits, metas)
    got = {r["id"]: (r["source"], r["module"], r["language"], r["source_file"]) for r in named.collect()}
    assert got == {1: ("unknown", "b.md", "unknown", "b.md"), 2: ("s", "a.md", "zh", "gone.md"), 3: ("bm25_match", "", "zh", ""), 4: ("s", "", "zh", "")}
    routes = spark.createDataFrame([("a.md", "/a/", "A"), ("b.md", "/a/", None)], "source_rel string, route string, title string")
    routed = retrieval.routed(named, routes)
    assert {r["id"]: (r["route"], r["title"]) for r in routed.collect()} == {1: ("/a/", "/a/"), 2: ("/a/", "A"), 3: (None, None), 4: (None, None)}
    assert [r["id"] for r in retrieval.best_routed(routed).collect()] == [1] and retrieval.unmapped(routed).first()[0] == 2
    found = spark.createDataFrame([(5, "x", 1), (6, "y", 2)], "id long, text string, ord int")
    context = spark.createDataFrame([(4, "w", 1), (5, "x", 2), (7, "w", 3), (8, "z", 4)], "id long, text string, ctx int")
    assert [(r["id"], r["text"]) for r in retrieval.with_neighbours(found, context).orderBy("ord").collect()] == [(5, "x"), (6, "y"), (4, "w"), (8, "z")]
    chunks = spark.createDataFrame([("f", i, str(i)) for i in range(12)], "f string, pos long, t string")
    ctx = retrieval.neighbours(spark.createDataFrame([("f", 10)], "f string, pos long"), chunks, "f", "pos", lexicographic=True)
    assert [r["pos"] for r in ctx.orderBy("ctx").collect()] == [10, 11, 8, 9]
    docs = spark.createDataFrame([(i, "c" * 600, 0.5 - i / 10, i) for i in range(3)], "id long, text string, sim double, ord int")
    assert [(r["id"], len(r["content"]), r["score"]) for r in retrieval.search(docs, 2, chars=400).collect()] == [(0, 400, 0.5), (1, 400, 0.4)]
    assert len(value(spark, retrieval.rerank_input(F.lit("a" * 2000)))) == 1500


@F.pandas_udf(ArrayType(FloatType()))
def lengths(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [float(len(x)), 1.0])


def test_knowledge_base_is_rebuilt_and_updated(spark, tmp_path):
    path, docs = str(tmp_path / "kb"), lambda *texts: spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts) if t], "file string, text string")
    args = ("file", "text", F.lit("docs"), lengths, "m")
    manifest = scratch.stored(knowledge.rebuild(docs("one text of some length", "another text of some length", "few words of its own there"), path, *args))
    first = {r["chunk_id"] for r in knowledge.load_vectors(spark, path).collect()}
    ix = knowledge.lexical_index(spark, path)
    assert len(first) == 3 and [r["id"] in first for r in lexical.bm25_top(ix, ["another"]).collect()] == [True]
    assert knowledge.lexical_index(spark, path).version == ix.version == 0
    assert knowledge.update(docs("one text of some length", "another text of some length", "few words of its own there"), manifest, path, *args)[0] == "current"
    status, _ = knowledge.update(docs("one text of some length", "a changed text of some length", "a third text of some length"), manifest, path, *args)
    stored = knowledge.load_vectors(spark, path)
    assert status == "updated" and stored.count() == 3 and len(first & {r["chunk_id"] for r in stored.collect()}) == 1
    assert {r["text"]: r["embedding"][0] for r in stored.collect()} == {r["text"]: float(len(r["text"])) for r in stored.collect()}
    bad = scratch.stored(stored.withColumn("embedding", F.when(F.col("text").startswith("one"), F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))))
    with pytest.raises(ValueError, match="not whole"):
        knowledge.load_vectors(spark, bad.inputFiles()[0].rsplit("/", 1)[0])


def test_quotas_in_order_by_scalar_replay(spark):
    """Users, addresses and times with nulls; every gate refuses something, and what refused uploads would have taken is left for later ones."""
    r = random.Random(11)
    mb = 1 << 20
    ups = [(i, r.choice([None, 1, 2, 3]), r.choice([None, "a", "b"]), r.choice([None, 0, mb, 5 * mb, 21 * mb]), r.choice([None, 0, 1, 2, 3, 4]), r.choice([None, 1, 1, 2, 3])) for i in range(160)]
    t = labels.Tunables(total_mb=90, files_per_user=24, files_per_ip_day=9)
    df = spark.createDataFrame(ups, "id long, user_id long, ip string, bytes long, files int, day int").withColumn("created_at", F.expr("timestamp_seconds(1700000000 + day * 86400 + id * 7 % 400)"))
    total, users, ips, want = 0, Counter(), Counter(), {}
    at = lambda u: (-1, u[0]) if u[5] is None else (u[5] * 86_400 + u[0] * 7 % 400, u[0])
    for i, user, ip, size, files, day in sorted(ups, key=at):
        size, files = size or 0, files or 0
        gate = "total" if total + size > 90 * mb else "file" if size > 20 * mb else "submit" if files > 3 else "user" if users[user] + files > 24 else "ip_day" if ips[ip, day] + files > 9 else None
        want[i] = gate
        if gate is None:
            total, users[user], ips[ip, day] = total + size, users[user] + files, ips[ip, day] + files
    got = {x["id"]: x["refused"] for x in quotas.quota_replay(df, t=t).collect()}
    assert got == want and set(want.values()) == {None, "total", "file", "submit", "user", "ip_day"}
    assert quotas.quota_replay(df.limit(0)).count() == 0


def test_content_tree_finds_what_changed(spark):
    rows = [(f"p{i}", f"text {i % 50}") for i in range(700)]
    docs = lambda x: ingest.manifest(spark.createDataFrame(x, "path string, text string"), "path", "text")
    before, after = docs(rows), docs([(k, "new" if k == "p5" else t) for k, t in rows if k != "p9"] + [("q", "added")])
    a, b = scratch.stored(ingest.content_tree(before, depth=2)), scratch.stored(ingest.content_tree(after, depth=2))
    assert ingest.fingerprint_of(a).first() == ingest.fingerprint_of(ingest.content_tree(before.repartition(7), depth=2)).first() != ingest.fingerprint_of(b).first()
    slices = ingest.changed_slices(a, b, 2)
    assert 1 <= slices.count() <= 3 and ingest.changed_slices(a, a, 2).count() == 0
    want = sorted(map(tuple, ingest.drift(before, after).collect()))
    assert sorted(map(tuple, ingest.drift_by_trees(before, after, a, b, 2).collect())) == want == [("p5", "modified"), ("p9", "removed"), ("q", "added")]
    none = ingest.content_tree(before.limit(0), depth=2)
    assert ingest.changed_slices(none, b, 2).count() == b.where("level = 2").count() and ingest.content_depth(700) == 1 and ingest.content_depth(10**9) == 6


def test_a_batch_written_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write = writers.batch_writer(path)
    for batch, n in ((0, 3), (1, 4), (1, 4), (0, 3)):
        write(spark.range(n).withColumn("b", F.lit(batch)), batch)
    assert sorted((r["b"], r["id"]) for r in writers.read_batches(spark, path).collect()) == [(0, i) for i in range(3)] + [(1, i) for i in range(4)]
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for again in range(2):  # the second stream has lost its checkpoint and writes the same batch
        query = stream.writeStream.foreachBatch(writers.batch_writer(str(tmp_path / "s"))).option("checkpointLocation", str(tmp_path / f"c{again}")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(r["id"] for r in writers.read_batches(spark, str(tmp_path / "s")).collect()) == list(range(20))


def test_rerank_in_batches_by_id(spark):
    """Scores come back by id, from batches of bounded size; an id that the model leaves out has 0."""
    found = spark.createDataFrame([(i, f"text {i}", 0.1, 0, i + 1, str(i)) for i in range(95)], "id long, text string, sim double, leg int, ord int, h string")

    def model(texts):
        assert 0 < len(texts) <= 40
        return {i: float(i % 7) for i in reversed(list(texts)) if i % 5}

    got = {r["id"]: r["rerank"] for r in retrieval.rerank(found, model).collect()}
    assert got == {i: float(i % 7) if i % 5 else 0.0 for i in range(95)}
    best = retrieval.search(retrieval.rerank(found, model), 3, scorer=F.col("rerank")).orderBy("ord").collect()
    assert [r["id"] for r in best] == [6, 13, 27] and abs(best[0]["score"] - 0.9975) < 1e-4
    assert retrieval.rerank(found.limit(0), model).count() == 0
