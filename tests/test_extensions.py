"""Dictionaries as tables, readers by format, table functions."""

import io
import json
import random
import re
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.functions import dictionary as D
from folioframe.functions.tables import register_tables
from folioframe.operators import mining as M
from folioframe.sources import files

TERMS = "term string, spoken string, custom boolean, fold boolean"


def one_by_one(text, rows):
    """Term after term, custom ones first and longer ones first, over text that nothing was put into yet."""
    parts = [(text, None)]
    for term, spoken, _, fold in sorted(rows, key=lambda r: (not r[2], -len(r[0]))):
        done, place = [], 0
        for part, said in parts:
            at = 0
            for m in re.finditer(re.escape(term), part, re.I if fold else 0) if said is None else ():
                s, e = place + m.start(), place + m.end()
                if (s and re.match(r"\w", text[s - 1])) or (e < len(text) and re.match(r"\w", text[e])):
                    continue
                done += [(part[at : m.start()], None), (m[0], spoken)]
                at = m.end()
            done.append((part[at:], said))
            place += len(part)
        parts = [p for p in done if p[0]]
    return "".join(p if said is None else said for p, said in parts)


def test_finder_equals_one_term_after_the_other():
    rng = random.Random(4)
    words = ["a.", "a.b", "b", "Dr.", "St. Dr", "b c", "c", "é", "x-1", "1"]
    for _ in range(3000):
        # terms that can't share a start and a length, so that order alone decides
        rows = [(t, f"<{t}>", rng.random() < 0.4, False) for t in rng.sample(words, 4)]
        text = "".join(rng.choice([*words, " ", " ", "-", "."]) for _ in range(rng.randint(0, 9)))
        assert D.Finder(rows).replaced(text)[0] == one_by_one(text, rows)


def test_finder_scales_with_terms_and_repeats():
    rows = [(f"term{i}", f"t {i}", False, i % 2 == 0) for i in range(10_000)]
    finder, text = D.Finder(rows), " ".join(f"TERM{i} term{i}" for i in range(10_000)) + " aaaa" * 100_000
    began = time.process_time()
    said, hits = finder.replaced(text)
    assert time.process_time() - began < 5 and len(hits) == 10_000 and sum(n for _, n in hits) == 15_000 and said.startswith("t 0 t 0 TERM1 t 1 ")


def test_dictionary_on_frames(spark):
    terms = spark.createDataFrame([("Dr.", "Doctor", False, False), ("dr.", "Drive", True, False), ("CHF", "heart failure", False, True), ("chf", "custom", True, True), (None, "x", None, None), ("", "y", False, False)], TERMS)
    docs = spark.createDataFrame([(1, "Dr. X of Main dr. has chf. CHFs", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, "Dr. Dr.", "en", "s")], "doc_id long, text string, lang string, source string")
    out = D.apply_dictionary(docs, terms)
    got = {r.doc_id: (r.text, [tuple(h) for h in r.hits]) for r in out.collect()}
    assert got == {1: ("Doctor X of Main Drive has custom. CHFs", [("Dr.", 1), ("chf", 1), ("dr.", 1)]), 2: (None, []), 3: ("", []), 4: ("Doctor Doctor", [("Dr.", 2)])}
    assert {(r.lang, r.source, r.term, r.hits, r.docs) for r in D.rule_hits(out).collect()} == {("en", "s", "Dr.", 3, 2), ("en", "s", "dr.", 1, 1), ("en", "s", "chf", 1, 1)}
    with pytest.raises(ValueError, match="3 terms"):
        D.apply_dictionary(docs, terms, most=3)


def test_one_reader_per_format(spark, tmp_path):
    (tmp_path / "a1.txt").write_text("# Head\nbody")
    (tmp_path / "b.txt").write_text("left alone")
    (tmp_path / "a2.csv").write_text('x,y\n"1,5",\n')
    (tmp_path / "a3.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["t", "u"]}, {"cell_type": "code", "source": "c"}], "metadata": {}}))
    (tmp_path / "a4.ipynb").write_text("{")
    (tmp_path / "a5.bin").write_text("?")
    read = lambda **o: {r.path.rsplit("/", 1)[-1]: (r.format, r.title, r.text) for r in files.read_catalog(spark, str(tmp_path), **o).collect()}
    want = {"a1.txt": ("text", "Head", "# Head\nbody"), "a2.csv": ("csv", "a2", "| x | y |\n|---|---|\n| 1,5 |  |"), "a3.ipynb": ("notebook", "a3", "tu\n\n```python\nc\n```"), "a4.ipynb": ("notebook", "a4", None)}
    assert read(only="a*") == want and set(read()) == {*want, "b.txt"}
    before = {k: [*v] for k, v in files._READERS.items()}
    try:
        own = lambda name: lambda s, path: s.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(name).alias("title"), F.upper("value").alias("text"))
        files.register_reader("bin", own("late"), 50)
        files.register_reader(".TXT", own("own"), 10)
        files.register_reader("txt", own("other"), 20)
        got = read(only="a*")
        assert got["a5.bin"][1:] == ("late", "?") and got["a1.txt"][1:] == ("own", "# HEAD\nBODY")
        assert files.read_registered(spark, {"txt": str(tmp_path / "b.txt")}).first().title == "own"
    finally:
        files._READERS.clear()
        files._READERS.update(before)
    assert files.read_catalog(spark, str(tmp_path), only="none").count() == 0


def test_long_quoted_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"' + "long " * 100_000 + '""' * 20_000 + '",y\n')
    cells = files.read_delimited(spark, str(tmp_path / "a.csv")).first().cells
    assert len(cells) == 3 and len(cells[1]) == 520_000 and cells[2] == "y"


def test_table_functions_equal_the_operators(spark):
    register_tables(spark)
    texts = [(1, "Alpha Beta spoke. We saw Marie Curie at New York City\nNew Delhi Airport"), (2, None), (3, ""), (4, " Ada Lovelace and Ada Lovelace")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = spark.sql("select doc_id, c.* from {d}, lateral concepts_of(text) c", d=docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.concept_spans(docs).select("doc_id", "start", "end", "text").collect())) and len(got) == 4
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>b <a href=u>c</a>"), (2, None)], "page_id long, html string")
    got = spark.sql("select page_id, b.* from {p}, lateral page_blocks_of(html) b", p=pages).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, files.page_blocks(pages).collect()), key=repr) and len(got) == 3


@pytest.mark.parametrize("range_bytes", [9_000, 1 << 26])
def test_archives_in_ranges(spark, tmp_path, range_bytes):
    data = {f"d{i}/{i}.txt": bytes([65 + i % 26]) * (37 * i) for i in range(60)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in data.items():
            z.writestr(name, content)
    for name, mode in (("b.tar", "w"), ("c.tgz", "w:gz"), ("d.tar.xz", "w:xz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for member, content in data.items():
                info = tarfile.TarInfo(member)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "short.tar").write_bytes((tmp_path / "b.tar").read_bytes()[:40_000])
    whole = (tmp_path / "a.zip").read_bytes()
    at = whole.index(b"d50/50.txt") + 12
    (tmp_path / "hurt.zip").write_bytes(whole[:at] + b"?????" + whole[at + 5 :])
    got = files.archive_members(spark, str(tmp_path), content=True, range_bytes=range_bytes).collect()
    by = {}
    for r in got:
        assert r.ref == f"{r.path}!{r.member}" and (r.content is None) == (r.error is not None)
        assert by.setdefault(r.path.rsplit("/", 1)[-1], {}).setdefault(r.member, r.content) is r.content
    assert all(by[n] == data for n in ("a.zip", "b.tar", "c.tgz", "d.tar.xz")) and "bad.zip" not in by
    assert by["hurt.zip"].pop("d50/50.txt") is None and by["hurt.zip"] == {k: v for k, v in data.items() if k != "d50/50.txt"}
    kept = {k: v for k, v in by["short.tar"].items() if v is not None}
    assert 10 < len(kept) < 60 and all(data[k] == v for k, v in kept.items())
    names = files.archive_members(spark, str(tmp_path / "a.zip"), range_bytes=range_bytes).collect()
    assert {r.member: r.size for r in names} == {k: len(v) for k, v in data.items()} and all(r.content is None for r in names)


def test_bookmarks_keep_their_document_order(spark):
    from folioframe.operators import listing

    rows = [(d, p) for p in (5, 1, 9, 3) for d in ("a", "b", "c")]
    got = listing.bookmarks_in_order(spark.createDataFrame(rows, "doc string, char_pos int")).select("doc", "char_pos", F.spark_partition_id().alias("p")).collect()
    for doc in "abc":
        mine = [r for r in got if r.doc == doc]
        assert [r.char_pos for r in mine] == [1, 3, 5, 9] and len({r.p for r in mine}) == 1


def test_abbreviations_one_by_one_and_as_a_table(spark):
    from folioframe.functions.normalize import expand_abbreviations

    docs = spark.createDataFrame([(1, "Dr. No vs. Dr.X, approx. 5 cf. etc."), (2, None)], "doc_id long, text string")
    builtin, custom = {"Dr.": "Doctor", "approx.": "about", "cf.": "compare"}, {"cf.": "see", "vs.": "against"}
    plain = {r.doc_id: r.t for r in docs.select("doc_id", expand_abbreviations(F.col("text"), builtin, custom).alias("t")).collect()}
    terms = [(k, v, c, False) for t, c in ((builtin, False), (custom, True)) for k, v in t.items()]
    assert plain == {1: "Doctor No against Dr.X, about 5 see etc.", 2: None}
    assert {r.doc_id: r.text for r in D.apply_dictionary(docs, spark.createDataFrame(terms, TERMS)).collect()} == plain
