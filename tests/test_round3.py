"""Findings of round 3: one small case each that failed before."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioframe.functions import dictionary as D
from folioframe.operators import mining as M
from folioframe.operators import review as R
from folioframe.session import dealt


def run_both(spark, folder, name):
    """Rows of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return key(got.select(*columns).collect()), key(want.fetchall())


def test_long_streaks_stay_inside_an_int(spark):
    """the older rule's interval grows past an int."""
    log = spark.createDataFrame([(1, dt.date(2024, 1, 1), i, 4) for i in range(60)] + [(2, dt.date(2024, 1, 1), i, 4) for i in range(15)], "card_id long, day date, event_id long, grade int")
    out = R.schedule_reviews(log, rule="sm2").select("card_id", "state.interval", "state.reps", F.col("state.next_review").cast("string")).orderBy("card_id").collect()
    assert out[0][1:3] == (2**31 - 1, 60) and out[0][3] == "+5881580-07-10"
    reps, ivl, ease = 0, 0, 2.5
    for _ in range(15):
        ivl = 1 if reps == 0 else 6 if reps == 1 else round(ivl * ease)
        reps, ease = reps + 1, round(ease + 0.1, 4)
    assert ivl > 36500 and out[1][1] == ivl


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Reviews of which several share card, day and event, and one whose difficulty ends in half a thousandth."""
    folder = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.execute("create view e as select * from '/root/testdata/sf0.1/events.parquet'")
    con.execute(f"copy (select event_id // 400 as event_id, ts, user_id, event_type, value, props from e where user_id < 120 union all select * from e where user_id in (920) order by hash(event_id)) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"copy (from '/root/testdata/sf0.001/orders.parquet') to '{folder}/orders.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["due_queue", "external_schedule", "schedule_reviews", "review_states_by_fold", "review_stream"])
def test_schedules_with_ties_equal_their_sql(spark, tied, name):
    """Reviews that share day and event, and halves of a thousandth."""
    mine, theirs = run_both(spark, tied, name)
    assert mine == theirs


def test_text_files_hold_a_bounded_number_of_texts(spark, monkeypatch):
    """a task's whole file must not grow with the table."""
    from folioframe.sources import files

    read, seen = files.read_text_corpus, []
    monkeypatch.setattr(files, "read_text_corpus", lambda s, path: seen.append(path) or read(s, path))
    mine, theirs = run_both(spark, Path("/root/testdata/sf0.01"), "read_text_corpus")
    assert mine == theirs
    assert max(p.read_bytes().count(b"\n") for p in Path(seen[0].removeprefix("file://")).glob("part-*.txt")) <= 200


def test_a_cell_does_not_carry_its_notebook(spark, tmp_path):
    """rows of cells hold their cell only."""
    from folioframe.sources import files

    (tmp_path / "a.ipynb").write_text('{"cells": [{"cell_type": "code", "source": ["x", "y"]}, {"cell_type": "markdown", "source": "z"}], "metadata": {"kernelspec": {"language": "r"}}}')
    cells = files.notebook_cells(spark, str(tmp_path))
    assert [tuple(r) for r in cells.select("n", "kind", "language", "source").orderBy("n").collect()] == [(0, "code", "r", "xy"), (1, "markdown", "r", "z")]
    carried = re.findall(r"Generate posexplode\([^)]*\), (.*)", cells._jdf.queryExecution().optimizedPlan().toString())
    assert carried and not any(re.search(r"\bj#", c) for c in carried)


@pytest.mark.parametrize(("module", "run", "name"), [("extension_queries", "CATALOG_RUN", "read_catalog"), ("stream_queries", "HOT_RUN", "hot_folder")])
def test_sources_in_several_files(spark, monkeypatch, module, run, name):
    """a source's files put together have the lines of its texts."""
    import importlib

    monkeypatch.setattr(importlib.import_module(f"folioframe.plans.{module}"), run, 70)
    mine, theirs = run_both(spark, Path("/root/testdata/sf0.001"), name)
    assert mine == theirs


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_words_at_offsets_look_back_only(spark):
    """a frame that looks ahead is computed anew for every word of a document."""
    from folioframe.operators import shaping as S

    docs = spark.createDataFrame([(1, " ab  \U0001f600c d e"), (2, ""), (3, None)], "doc_id long, text string")
    targets = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 9), (1, 99)], "doc_id long, offset int")
    found = S.word_at_offset(S.tokens_of(docs), targets)
    assert [tuple(r) for r in found.orderBy("offset").collect()] == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 9, 2), (1, 99, 2)]
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(found)


def test_words_stay_with_their_document(spark):
    """Words get their places and times without a window over a shuffle."""
    from folioframe.operators import shaping as S

    docs = spark.createDataFrame([(1, "ab c"), (2, None), (3, " ")], "doc_id long, text string")
    assert [tuple(r) for r in S.tokens_of(docs).collect()] == [(1, 0, "ab", 0, 2), (1, 1, "c", 3, 4)]
    assert [tuple(r) for r in S.allocate_time(docs, F.lit(10.0)).collect()] == [(1, 0, "ab", 0.0, 6.0), (1, 1, "c", 6.0, 10.0)]
    assert S.allocate_time(docs, F.lit(None)).collect()[0]["end_s"] is None
    assert "Window" not in plan_of(S.tokens_of(docs)) + plan_of(S.allocate_time(docs, F.lit(10.0)))


def test_tables_and_chapters_stay_with_their_document(spark):
    """no window, join or grouping over the lines of all documents; odd tables as before."""
    from folioframe.operators import shaping as S

    text = "pre\n|a|b|\n|---|---|\n|1||\n| |\n|2|3|4|\n\n|-|\nx\n|c|\n|5|\n# H #\n\n## A\nz"
    docs = spark.createDataFrame([(1, "t", text), (2, "t", None), (3, " ", "")], "doc_id long, title string, text string")
    rows = S.table_rows(docs)
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [(1, 1, 0, "a", "1"), (1, 3, 0, "a", "2"), (1, 3, 1, "b", "3"), (1, 3, 2, "Column 3", "4"), (3, 1, 0, "c", "5")]
    said = S.narrate_tables(docs)
    assert sorted(tuple(r) for r in said.collect()) == [(1, 1, "Row 1: a is 1.\nRow 3: a is 2, b is 3, Column 3 is 4."), (1, 3, "Row 1: c is 5.")]
    chapters = S.split_chapters(docs)
    found = sorted(tuple(r)[1:3] for r in chapters.collect())
    assert found == [(0, "t"), (1, "H"), (2, "A")] and chapters.filter("chapter = 1").collect()[0]["body"] == "H"
    around = S.block_context(docs)
    assert tuple(around.filter("doc_id = 3").collect()[0]) == (3, 0, None, None, 0, 0, None, None)
    assert tuple(around.filter("doc_id = 1 and n = 8").collect()[0]) == (1, 8, None, 11, 7, 13, 7, 9)
    for frame in (rows, said, chapters, around):
        assert not re.search("Window|Join|Aggregate", plan_of(frame))


def test_blocks_of_many_pages_go_out_in_parts(spark, monkeypatch):
    """what Python holds of a batch of pages is bounded."""
    from folioframe.sources import files

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            return f

    import pyarrow as pa

    parse = files.page_blocks(Pages())
    sizes = [b.num_rows for b in parse([pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None]), pa.array(["<p>x</p>" * 9000, "<p>y</p>" * 9000, None, "<p>z</p>"])], ["page_id", "html"])])]
    assert sum(sizes) == 18_001 and max(sizes) <= 10_000


def test_terms_that_are_words_are_looked_up(spark):
    """short terms are not met inside every longer word, and no automaton walks the text for them."""
    finder = D.Finder([("a", "1", False, False), ("aa", "2", False, False), ("Ab", "3", True, True), ("ab", "4", False, False), ("é_1", "5", False, False)])
    assert not finder.automata
    assert finder.replaced("a aa aaa ab AB é_1 é_1x a-a") == ("1 2 aaa 3 3 5 é_1x 1-1", [("Ab", 2), ("a", 3), ("aa", 1), ("é_1", 1)])
    mixed = D.Finder([("a", "1", False, False), ("a-a", "6", False, False)])
    assert mixed.replaced("a a-a") == ("1 6", [("a", 1), ("a-a", 1)])
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("a", "x")], "term string, spoken string")
    assert [tuple(r) for r in D.apply_dictionary(docs, terms).orderBy("doc_id").collect()] == [(1, "x b", [("a", 1)]), (2, None, []), (3, "", [])]


def test_work_stays_behind_the_dealing_out(spark, tmp_path):
    """What is computed per text is not computed in front of the exchange, by the one task that reads the file."""
    spark.createDataFrame([(1, "A b. C d."), (2, "x y z")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = dealt(spark.read.parquet(str(tmp_path / "t")), "doc_id").withColumn("said", F.concat("text", F.lit(" e")))
    terms = spark.createDataFrame([("b", "B")], "term string, spoken string")
    for made in (docs.select("doc_id", F.explode(F.split("text", " "))), M.align_tokens(docs, spoken="text", rendered="said"), D.apply_dictionary(docs, terms).select("doc_id", F.explode("hits"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        in_front = " ".join(re.findall("RepartitionByExpression.*?Relation", plan, re.DOTALL))
        assert in_front
        assert "split(" not in in_front and "regexp_extract_all" not in in_front and "replace(" not in in_front and "Filter" not in in_front
    plan = D.apply_dictionary(docs, terms).select("doc_id", F.explode("hits"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(text") == 1


def test_frequent_words_go_before_rare_ones_are_looked_up(spark):
    """One word of a third of all rows is not dealt out by itself."""
    docs = spark.createDataFrame([(1, "common Rare common new"), (2, None), (3, "rare rare")], "doc_id long, text string")
    known = spark.createDataFrame([("common", 5.0), ("rare", 4.0), ("null", None)], "word string, zipf double")
    got = M.difficult_words(docs, known, least=3)
    assert sorted(map(tuple, got.collect())) == [(1, "new"), (1, "rare"), (3, "rare")]
    for made in (got, M.rare_words(docs.withColumn("n", F.lit(0)), known, ["doc_id", "n"], "text")):
        assert "Join LeftAnti" in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "rightHint=(strategy=broadcast)" in plan
    unlisted = M.difficult_words(docs, known, threshold=0.0)
    assert unlisted.count() == 0


def test_filled_places_of_arrays_equal_those_of_lists():
    """words are numbered and places filled by arrays."""
    for found in ([], [-1], [3, -1], [-1, 2, -1, -1, 5, -1], [-1, -1]):
        assert M.filled_numbers(np.array(found, np.int64)).tolist() == M.filled_places([None if f < 0 else f for f in found])
    assert M.matched_numbers(np.array([0, 1, 2]), np.array([1, 2, 3])).tolist() == [-1, 0, 1]
