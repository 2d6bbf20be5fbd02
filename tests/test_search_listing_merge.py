"""Pinned cases of search, listings, merges, reviews and the graph."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import graph as G
from folioframe.operators import listing as L
from folioframe.operators import merge as M
from folioframe.operators import review as R
from folioframe.operators import search as S
from folioframe.operators import sessions


def test_search_counts_snippets_and_order(spark):
    docs = spark.createDataFrame([(1, "single", "one banana " + "x" * 100), (2, "repeat", "Banana banana BANANA"), (3, "none", None)], "doc_id long, title string, text string")
    got = S.search_content(docs, " Banana ").collect()
    assert [(r.doc_id, r.hits) for r in got] == [(2, 3), (1, 1)] and got[1].snippet.endswith("…") and got[1].snippet.startswith("one banana")
    assert S.search_content(docs, "  ").count() == 0


def test_find_and_replace(spark):
    docs = spark.createDataFrame([(1, "aaaa\nAba"), (2, "none")], "doc_id long, text string")
    assert sorted(r.offset for r in S.find_all(docs, "aa").collect()) == [0, 1, 2]
    assert [(r.line, r.matches) for r in S.find_regex(docs, "[").collect()] == []
    assert {r.line for r in S.find_regex(docs, "A.a").collect()} == {1}
    got = S.replace_all(docs, "aa", "$1").filter("doc_id = 1").first()
    assert (got.text, got.replaced) == ("$1$1\nAba", 2)


def test_note_queries(spark):
    notes = spark.createDataFrame([(1, "Deep thought", "anchor", ["Physics"]), (2, "other", "deep sea", [])], "id long, note string, anchor string, tags array<string>")
    ids = lambda q: sorted(r.id for r in S.match_notes(notes, q).collect())
    assert ids("deep") == [1, 2] and ids("deep #phys") == [1] and ids("") == [1, 2] and ids("#") == [] and ids("sea deep") == [2]


def test_library_search_criteria(spark):
    lib = spark.createDataFrame([("a", "Title", "Ann", "10.1/X", "978-0-306-40615-7"), ("b", "Other", "Bob", "https://doi.org/10.1/x", None)], "path string, title string, author string, doi string, isbn string")
    notes = spark.createDataFrame([("b", "mentions title words")], "doc string, note string")
    paths = lambda **k: sorted(r.path for r in S.search_library(lib, notes, **k).collect())
    assert paths(query="title") == ["a", "b"] and paths(doi="https://doi.org/10.1/x") == ["a", "b"] and paths(isbn="9780306406157") == ["a"]
    hit = spark.createDataFrame([("b",)], "path string")
    assert paths(query="zzz", content=hit) == ["b"] and paths(query="zzz", content=hit, author="ann") == []


@pytest.mark.parametrize(("isbn", "ok"), [("0306406152", True), ("080442957X", True), ("978-0-306-40615-7", True), ("0306406153", False), ("9780306406158", False), ("12345", False), (None, False)])
def test_isbn(spark, isbn, ok):
    assert spark.createDataFrame([(isbn,)], "i string").select(T.valid_isbn(F.col("i")).alias("v")).first().v is ok


def test_deepest_folder_and_other_mount(spark):
    folders = spark.createDataFrame([("/m/lib",), ("/m/lib/deep/",)], "folder string")
    paths = spark.createDataFrame([("/m/lib/a.txt",), ("/m/lib/deep/x/b.txt",), ("/m/library/c.txt",)], "path string")
    got = {r.path: (r.folder, r.rel) for r in L.owning_folder(paths, folders).collect()}
    assert got == {"/m/lib/a.txt": ("/m/lib", "a.txt"), "/m/lib/deep/x/b.txt": ("/m/lib/deep", "x/b.txt")}
    progress = spark.createDataFrame([("deep", "x/b.txt", 40)], "folder string, rel string, pct int")
    assert {r.path: r.pct for r in L.progress_lookup(paths, folders, progress).collect()} == {"/m/lib/a.txt": None, "/m/lib/deep/x/b.txt": 40}


def _merge(spark, a, b, **k):
    schema = "key string, offset int, pct int, ts string"
    return {r.key: ((r.offset, r.pct, r.ts), r.resolution) for r in M.merge_progress(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), **k).collect()}


def test_merge_policies(spark):
    a = [("newer", 1, None, "2"), ("older", 2, None, "1"), ("tie", 3, None, "1"), ("none", 4, None, None), ("same", 5, None, "1"), ("only", 6, None, "1"), ("pct", None, 10, "9")]
    b = [("newer", 9, None, "1"), ("older", 1, None, "2"), ("tie", 9, None, "1"), ("none", 1, None, "0"), ("same", 5, None, "1"), ("there", 7, None, "1"), ("pct", None, 90, "1")]
    got = _merge(spark, a, b)
    assert {k: (v[0][0], v[1]) for k, v in got.items() if k != "pct"} == {"newer": (1, "local"), "older": (1, "remote"), "tie": (9, "remote"), "none": (1, "remote"), "same": (5, None), "only": (6, None), "there": (7, None)}
    assert _merge(spark, a, b, prefer="local")["tie"] == ((3, None, "1"), "local") and _merge(spark, a, b, policy="odd") == got
    high = _merge(spark, a, b, policy="highest_progress")
    assert high["newer"] == ((9, None, "1"), "remote") and high["pct"] == ((None, 90, "1"), "remote")
    assert _merge(spark, a, b, policy="manual")["tie"] == ((3, None, "1"), "unresolved")


def test_merge_is_idempotent_and_notes_without_ids_stay(spark):
    schema = "doc string, id string, note string, ts string, pos int"
    a = spark.createDataFrame([("d", "1", "old", "1", 0), ("d", None, "free", None, 1)], schema)
    b = spark.createDataFrame([("d", "1", "new", "2", 0), ("d", "2", "first", "1", 1), ("d", "2", "second", "9", 2), ("d", None, "other", None, 3)], schema)
    got = [(r.id, r.note) for r in M.merge_notes(a, b).orderBy("position").collect()]
    assert got == [("1", "new"), (None, "free"), ("2", "first"), (None, "other")]


def test_index_actions(spark):
    schema = "path string, size int, mtime int, text string"
    old = spark.createDataFrame([("same", 1, 1, "a"), ("changed", 1, 1, "b"), ("gone", 1, 1, "c"), ("bad", 1, 1, "d")], schema)
    new = spark.createDataFrame([("same", 1, 1, None), ("changed", 2, 1, "B"), ("bad", 2, 1, None), ("new", 1, 1, "n"), ("newbad", 1, 1, None)], schema)
    got = {r.path: (r.action, r.text) for r in M.refresh_index(old, new).collect()}
    assert got == {"same": ("reuse", "a"), "changed": ("extract", "B"), "gone": ("drop", None), "bad": ("stale", "d"), "new": ("extract", "n"), "newbad": ("failed", None)}


PINS = [(1, 0.4072, 7.2102, 1, 1), (2, 1.1829, 6.5085, 0, 1), (4, 15.4722, 3.2829, 0, 15)]


@pytest.mark.parametrize(("grade", "stability", "difficulty", "lapses", "interval"), PINS)
def test_first_review(spark, grade, stability, difficulty, lapses, interval):
    log = spark.createDataFrame([(1, dt.date(2026, 1, 1), 1, grade)], "card_id long, day date, event_id long, grade int")
    s = R.schedule_reviews(log).first().state
    assert (s.stability, s.difficulty, s.lapses, s.reps, s.interval) == (stability, difficulty, lapses, 1, interval)


def test_review_sequence_and_stream_step(spark):
    from folioframe.streaming.streams import fold_review

    days = [(dt.date(2026, 1, 1), 3), (dt.date(2026, 1, 4), 3), (dt.date(2026, 1, 15), 1), (dt.date(2026, 1, 16), 2), (dt.date(2026, 1, 19), 4)]
    want = [(3.1262, 5.3146, 0, 1, 3), (11.3884, 5.2671, 0, 2, 11), (2.3341, 6.3147, 1, 3, 1), (2.9374, 6.6697, 1, 4, 3), (21.5465, 6.2055, 1, 5, 22)]
    rows = [(n, d, i, g) for n in range(1, 6) for i, (d, g) in enumerate(days[:n])]
    got = {r.card_id: r.state for r in R.schedule_reviews(spark.createDataFrame(rows, "card_id long, day date, event_id long, grade int")).collect()}
    state = None
    for n, (d, g) in enumerate(days, 1):
        state = fold_review(state, d, g)
        s = got[n]
        assert (s.stability, s.difficulty, s.lapses, s.reps, s.interval) == want[n - 1] == (state[0], state[1], state[4], state[3], state[2])
        assert s.next_review == state[6]


def test_sm2(spark):
    rows = [(1, dt.date(2026, 1, d), d, g) for d, g in ((1, 3), (2, 3), (8, 3))] + [(2, dt.date(2026, 1, d), d, 1) for d in range(1, 9)]
    got = {r.card_id: r.state for r in R.schedule_reviews(spark.createDataFrame(rows, "card_id long, day date, event_id long, grade int"), rule="sm2").collect()}
    assert (got[1].interval, got[1].ease) == (15, 2.5) and (got[2].interval, got[2].ease, got[2].lapses) == (1, 1.3, 8)


def test_queue_and_summary(spark):
    cards = spark.createDataFrame(
        [("d", 1, (5.0, 5.0, 5, 1, 0, dt.date(2026, 1, 1), dt.date(2026, 1, 6), 2.5)), ("d", 2, (5.0, 5.0, 5, 1, 0, dt.date(2026, 1, 1), dt.date(2026, 1, 3), 2.5)), ("d", 3, None), ("d", 4, (5.0, 5.0, 5, 1, 0, dt.date(2026, 1, 9), dt.date(2026, 1, 14), 2.5))],
        f"doc string, id long, state {R.STATE}",
    )
    assert [r.id for r in R.due_queue(cards, "2026-01-10").collect()] == [2, 1, 3]
    s = R.review_summary(cards, "2026-01-10").first()
    assert (s.total, s.due, s.new, s.reviewed) == (4, 3, 1, 3) and 0 < s.retention < 1
    exported = spark.createDataFrame([(["x", "card::3"], 12, 2300, 4, 1)], "tags array<string>, interval int, factor int, reps int, lapses int")
    got = {r.id: r.state for r in R.apply_external_schedule(cards, exported).collect()}
    assert got[3].ease == 2.3 and got[3].interval == 12 and got[1].interval == 5


def test_graph(spark):
    rel = "array<struct<rel_type:string,target_id:string,note:string>>"
    notes = spark.createDataFrame([("d", "a1", 0, "one", "", ["t"], [("supports", "a2", "")]), ("d", "a2", 1, "two", "", [], [(None, "zz", "")]), ("e", "a3", 2, "three", "", [], []), ("e", None, 3, "noid", "", [], [])], f"doc string, id string, char_pos int, anchor string, note string, tags array<string>, relations {rel}")
    nodes, edges = G.build_graph(notes)
    assert nodes.count() == 4 and {(r.src, r.dst, r.rel_type) for r in edges.collect()} == {("a1", "a2", "SUPPORTS"), ("a2", "zz", "SEE_ALSO")}
    assert {r.id for r in G.connected_component(nodes, edges, "a2").collect()} == {"a1", "a2"}
    assert G.connected_component(nodes, edges, "zz").count() == 0 and [r.id for r in G.connected_component(nodes, edges, "a3").collect()] == ["a3"]
    assert G.degree_stats(nodes, edges, orphans=False).count() == 2 and G.neighbors(nodes, edges).filter("other is null").count() == 1


def test_sessions_break_at_gaps_pauses_and_documents(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(hours=h), i, d, s, w) for i, (h, d, s, w) in enumerate([(0, 1, True, 5), (1, 1, True, 9), (2, 2, True, 1), (3, 2, False, 2), (4, 2, True, 3), (40, 2, True, 4)])]
    got = sessions.reading_sessions(spark.createDataFrame(rows, "reader long, ts timestamp, event_id long, doc long, speaking boolean, word_idx int"), words_total=8).orderBy("started").collect()
    assert [(r.doc, r.seconds, r.words_read) for r in got] == [(1, 3600.0, 8), (2, 0.0, 2), (2, 0.0, 4), (2, 0.0, 5)]


def test_refreshed_texts_are_whole(spark):
    new = spark.createDataFrame([(1, 1)], "path long, size long").withColumn("text", F.repeat(F.lit("abcd"), 600_000))
    old = spark.createDataFrame([], "path long, size long, text string")
    assert M.refresh_index(old, new, mark=("size",)).select(F.length("text")).first()[0] == 2_400_000
