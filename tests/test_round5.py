"""Findings of round 4: one small case each that failed before."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_round3 import run_both
from test_stateful_streams import LOG, at, run

import __spark_entry__
from folioframe.operators import mining as M
from folioframe.operators import review as R
from folioframe.operators import shaping as S
from folioframe.streaming import streams as T


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Cards whose last stabilities, 14.50003 and 6.50000009, are kept as halves; cards below 300 take the schedule of an export."""
    folder = tmp_path_factory.mktemp("halves")
    reviews = [(card, day, grade) for card, log in ((900, ((1, 3), (4, 2), (26, 2))), (901, ((1, 2), (13, 1), (20, 2), (28, 2)))) for day, grade in log]
    rows = ", ".join(f"({n}, timestamp '2024-01-{day:02} 10:00:00', {card}, '{dict(enumerate(('error', 'view', 'click', 'purchase'), 1))[grade]}')" for n, (card, day, grade) in enumerate(reviews))
    con = duckdb.connect()
    con.execute(f"copy (select cast(e as bigint) as event_id, ts, cast(u as bigint) as user_id, t as event_type, 1.5::double as value, '{{}}' as props from (values {rows}) v(e, ts, u, t)) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"copy (from '/root/testdata/sf0.001/orders.parquet') to '{folder}/orders.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["due_queue", "external_schedule", "schedule_reviews", "review_states_by_fold", "review_stream"])
def test_intervals_are_those_of_the_kept_stability(spark, halves, name):
    """The interval was rounded from a stability that had not been rounded yet."""
    mine, theirs = run_both(spark, halves, name)
    assert mine == theirs and len(mine) == 2


def test_reviews_of_a_day_wait_for_the_whole_day(spark, tmp_path):
    """a watermark inside a day let its earlier reviews go before later ones of a smaller event; F9: cards share states."""
    rows = [(1, at(60), 5, at(60).date(), 3), (1, at(1380), 2, at(1380).date(), 1), (1, at(2000), 7, at(2000).date(), 2), (2, at(720 + 9 * 1440), 3, at(720 + 9 * 1440).date(), 4)]
    batches = [[rows[0]], [rows[3]], [rows[1], rows[2]], [(-1, at(10**5), 0, None, None)]]
    want = {r.card_id: r.state for r in R.schedule_reviews(spark.createDataFrame(rows, LOG)).collect()}
    found = run(spark, tmp_path, batches, LOG, lambda s: T.review_stream(s, late="9 days", groups=1), "update")
    got = {r.card_id: r for r in found.groupBy("card_id").agg(F.max_by(F.struct("*"), "reps").alias("s")).select("s.*").collect()}
    names = ("stability", "difficulty", "interval", "reps", "lapses", "last_review", "next_review")
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == {k: tuple(s[n] for n in names) for k, s in want.items()}


def test_parts_of_a_stream_are_several_files(spark, monkeypatch):
    """one task sorted and wrote a fifth of all rows."""
    from folioframe.plans import stream_queries as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 60)
    seen, of = [], Q._folder
    monkeypatch.setattr(Q, "_folder", lambda s, name: seen.append(of(s, name)) or seen[-1])
    mine, theirs = run_both(spark, Path("/root/testdata/sf0.001"), "review_stream")
    assert mine == theirs and len(mine) > 10
    sizes = [r.n for r in spark.read.parquet(seen[0]).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 * 4 + 1 and max(sizes) < 100


@pytest.fixture(scope="module")
def wordless(tmp_path_factory):
    """Documents of which some have no words."""
    folder = tmp_path_factory.mktemp("wordless")
    con = duckdb.connect()
    odd = "select doc_id + 100000 as doc_id, case doc_id % 4 when 0 then null when 1 then '' when 2 then e' \\n ' else 'word' end as text, * exclude (doc_id, text) from d where doc_id < 8"
    con.execute("create view d as select * from '/root/testdata/sf0.001/documents.parquet' where doc_id < 40")
    con.execute(f"copy (select doc_id, text, * exclude (doc_id, text) from d union all {odd}) to '{folder}/documents.parquet' (format parquet)")
    return folder


def test_documents_without_words_have_no_word_at_an_offset(spark, wordless):
    """they had rows without a word."""
    mine, theirs = run_both(spark, wordless, "word_at_offset")
    assert mine == theirs and len(mine) == 42 * 4


def test_long_runs_of_names_and_hyphens_make_cards(spark):
    """F8: a sentence of some thousand names ended with a stack overflow."""
    run_of_names = " ".join(f"Name{'abcdefghij'[i % 10]} of Xyz" for i in range(9_000))
    docs = spark.createDataFrame([(1, f"old {run_of_names} in 1903."), (2, "see " + "ab-" * 9_000 + "cd here.")], "doc_id long, text string")
    known = spark.createDataFrame([("see", 4.0), ("here", 4.0)], "word string, zipf double")
    got = {r.doc_id: r.terms for r in M.cloze_cards(docs, frequencies=known).collect()}
    assert got == {1: [run_of_names, "1903"], 2: ["here"]}


def test_highlights_move_no_words(spark):
    """all words went through three shuffles; only what is highlighted leaves the document now."""
    docs = spark.createDataFrame([(1, "ab  Cd,\nef cd. gh"), (2, ""), (3, None), (4, "x-y zz")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 3, 5), (1, 13, 12), (1, 9, None), (4, 0, 99)], "doc_id long, start int, end int")
    hard = spark.createDataFrame([(1, "cd"), (1, "gh"), (4, "xy"), (2, "ab")], "doc_id long, word string")
    for cap in (1, 2, 5000):
        made = S.highlight_texts(docs, spans, hard, cap=cap)
        want = S.highlight_words(S.tokens_of(docs), spans, hard, cap=cap)
        assert sorted(map(tuple, made.collect())) == sorted(tuple(r) for r in want.select(made.columns).collect())
    assert {(r.word, r.kind) for r in made.collect()} == {("Cd,", "user"), ("cd.", "user"), ("gh", "difficult"), ("x-y", "user"), ("zz", "user")}
    plan = __spark_entry__.queries()["highlight_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("idx#") and not any("Join" in line or "Window" in line for line in plan.split("MapInArrow")[0].splitlines())
