"""Files in, files out, and streams against their batch twins."""

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import vault as V
from folioframe.sources import files as A
from folioframe.sources import sinks as K
from folioframe.streaming import streams as T

CITED = ", ".join(f"{c} string" for c in A.CITATION)


def put(root, **texts):
    for name, text in texts.items():
        p = root / name.replace("__", "/").replace("_dot_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_catalog(spark, tmp_path):
    put(tmp_path, a_dot_md="x", sub__b_dot_txt="y", _dot_git__c_dot_md="z", _dot_hidden_dot_md="h", d_dot_exe="e", node_modules__e_dot_md="n", sub___dot_x_dot_txt="q")
    got = A.scan_catalog(spark, [str(tmp_path), str(tmp_path / "sub")]).collect()
    assert [(r.rel, r.format, r.size) for r in got] == [("a.md", "markdown", 1), ("sub/b.txt", "text", 1)]


def test_text_delimited_notebooks(spark, tmp_path):
    put(tmp_path, t__a_dot_md="---\nk: v\n---\n# Head\nbody", t__b_dot_txt="no heading", c__x_dot_csv='h1,h2\na|b,"c,""d"""\n1,2,3\n')
    assert {(r.title, r.text) for r in A.read_text_corpus(spark, str(tmp_path / "t")).collect()} == {("Head", "# Head\nbody"), ("b", "no heading")}
    rows = A.read_delimited(spark, str(tmp_path / "c"))
    assert [r.cells for r in rows.orderBy("row").collect()] == [["h1", "h2", ""], ["a|b", 'c,"d"', ""], ["1", "2", "3"]]
    assert A.delimited_markdown(rows).first().markdown.splitlines()[2] == '| a\\|b | c,"d" |  |'
    put(tmp_path, n__a_dot_ipynb=json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "print(1)"}, {"cell_type": "raw", "source": "r"}], "metadata": {}}), n__b_dot_ipynb="{broken")
    assert {(r.kind, r.language, r.source) for r in A.notebook_cells(spark, str(tmp_path / "n")).collect()} == {("markdown", "python", "# T\nx"), ("code", "python", "print(1)"), ("error", None, "no readable notebook")}


def test_archives_and_feeds(spark, tmp_path):
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "a.zip", "w") as z:
        for n in ("x.txt", "d/y.md", ".hidden.txt", "__MACOSX/x.txt", "b.exe"):
            z.writestr(n, "data")
    (tmp_path / "z" / "bad.zip").write_bytes(b"no archive")
    members = A.archive_members(spark, str(tmp_path / "z"), content=True)
    assert {(r.member, bytes(r.content)) for r in members.collect()} == {("x.txt", b"data"), ("d/y.md", b"data")}
    known = members.filter("member = 'x.txt'").select(F.col("ref").alias("path"))
    assert [r.member for r in A.new_members(members, known).collect()] == ["d/y.md"]
    item = lambda n, link: f"<item><title>t{n}</title>{f'<link>http://x/{n}</link>' if link else ''}<description>d</description></item>"
    put(tmp_path, f__feed_dot_xml="<rss><channel><title>F</title>" + "".join(item(n, n != 3) for n in range(120)) + "</channel></rss>")
    got = A.feed_items(spark, str(tmp_path / "f")).collect()
    assert len(got) == 49 and got[0].title == "t0" and got[0].published == ""


def test_pages_and_bibliographies(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://H.org/a", "<title>T</title><nav>no</nav><h2>Head</h2><p>Text <a href='/x'>in</a></p><ul><li>a<ul><li>b</li></ul></li></ul><img alt='pic' src='s.png'><a href='https://o.net/p'>out</a>"), (2, None, None)], "page_id long, url string, html string")
    blocks = A.page_blocks(pages)
    assert A.extract_pages(blocks).filter("page_id = 1").first().markdown.startswith("# T\n\n## Head\n\nText in\n\n- a\n\n  - b\n\n![pic](s.png)")
    assert {(r.href, r.host) for r in A.page_links(blocks, pages).collect()} == {("/x", "h.org"), ("https://o.net/p", "o.net")}
    put(
        tmp_path, b__a_dot_bib="@inproceedings{k1, title = {A {B} C}, booktitle={Proc}, year=2020}\n@book{k2, title=\"Q\", author = {X and Y}}", b__b_dot_ris="TY  - JOUR\nAU  - Doe, J\nAU  - Roe, K\nTI  - Thing\nPY  - 2019/01/01\nER  - \nTY  - BOOK\nTI  - open",
        b__c_dot_json=json.dumps([{"id": "c1", "title": "J", "author": [{"family": "F", "given": "G"}], "issued": {"date-parts": [[2021]]}}]),
    )
    got = {r.id: r for r in A.read_bibliography(spark, str(tmp_path / "b")).collect()}
    assert set(got) == {"k1", "k2", "Doe2019", "c1"} and got["k1"].journal == "Proc" and got["k1"].title == "A B C" and got["k2"].author == "X and Y"
    assert got["Doe2019"].author == "Doe, J and Roe, K" and got["Doe2019"].year == "2019" and got["c1"].author == "F, G" and got["c1"].year == "2021"
    back = A.parse_ris(K.write_citations(spark.createDataFrame(list(got.values()), CITED), "ris").select(F.concat("record", F.lit("\n")).alias("text")))
    assert {r.id: r.title for r in back.collect()} == {i: r.title for i, r in got.items()}
    assert json.loads(K.write_citations(spark.createDataFrame([got["c1"]], CITED), "json").first().record)["author"] == [{"family": "F", "given": "G"}]


def test_vault(spark):
    notes = spark.createDataFrame([("v/one.md", "---\ntitle: First\ntags: [x, y]\naliases:\n  - Uno\n---\nText #z and supports:: [[Two|label]]\n[[missing]] ![[embed]] [[two#part]]"), ("v/two.md", "plain [[uno]] [[UNO]]")], "path string, text string")
    vault = V.vault_notes(notes)
    one = vault.filter("path = 'v/one.md'").first()
    assert one.title == "First" and one.tags == ["x", "y", "z"] and one.aliases == ["Uno"]
    edges, lost = V.resolve_links(vault)
    assert {(r.src, r.dst, r.rel_type) for r in edges.collect()} == {("v/one.md", "v/two.md", "SUPPORTS"), ("v/one.md", "v/two.md", "SEE_ALSO"), ("v/two.md", "v/one.md", "SEE_ALSO")}
    assert V.vault_report(vault, edges, lost).first().asDict() == {"notes": 2, "relations": 3, "unresolved": 1}


def test_sinks(spark, tmp_path):
    names = spark.createDataFrame([("a", "x.md"), ("b", "X.md"), ("c", "x (2).md")], "source string, name string")
    got = {r.source: r.unique for r in K.unique_names(names).collect()}
    assert got["a"] == "x.md" and got["c"] == "x (2).md" and len({u.lower() for u in got.values()}) == 3
    with pytest.raises(ValueError, match="unknown output format"):
        K.resolve_format("nope")
    notes = spark.createDataFrame([("d", 1, 5, "anchor", "note", ["t"]), ("d", 2, 1, "", "only", []), ("d", 3, 9, " ", None, [])], "doc string, id long, char_pos int, anchor string, note string, tags array<string>")
    assert K.write_notes(notes).first().artefact.startswith("1. only\n\n2. > anchor\nnote") and len(json.loads(K.write_notes(notes, "json").first().artefact)) == 3
    edges = spark.createDataFrame([(1, 2, "SUPPORTS"), (1, 99, "SEE_ALSO")], "src long, dst long, rel_type string")
    assert K.write_graph(notes, edges, "json").filter("part = 'edge'").count() == 2 and K.write_graph(notes, edges, "puml").filter("part = 'edge'").count() == 1
    vault = {r.id: r for r in K.write_vault(notes, edges).collect()}
    assert "SUPPORTS:: [[only]]" in vault[1].content and "99" not in vault[1].content
    assert K.write_cards(notes).count() == 2
    K.write_text(K.write_notes(notes), str(tmp_path / "out"), "artefact", by="doc")
    assert (tmp_path / "out" / "doc=d").is_dir()
    cues = spark.createDataFrame([(1, 0, 0.0, 0.0, "a"), (1, 1, 3661.5, 3662.0, "b")], "doc_id long, n int, start_s double, end_s double, cue string")
    assert [r.block for r in K.write_captions(cues, "vtt").collect()] == ["WEBVTT\n\n00:00:00.000 --> 00:00:00.050\na\n", "01:01:01.500 --> 01:01:02.000\nb\n"]


def test_hot_folder_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    put(folder, a_dot_txt="text", b_dot_txt="")
    (folder / "b.txt").write_bytes(b"\xff\xfe bad")
    os.utime(folder / "a.txt", (time.time() - 60,) * 2)
    os.utime(folder / "b.txt", (time.time() - 60,) * 2)
    T.watch_and_convert(spark, str(folder), str(out)).awaitTermination()
    put(folder, c_dot_txt="more")
    os.utime(folder / "c.txt", (time.time() - 30,) * 2)
    T.watch_and_convert(spark, str(folder), str(out)).awaitTermination()
    log = spark.read.parquet(str(out / "log"))
    assert {(r.source.rsplit("/", 1)[-1], r.ok) for r in log.collect()} == {("a.txt", True), ("b.txt", False), ("c.txt", True)} and log.count() == 3
    assert spark.read.parquet(str(out / "failed")).count() == 1


def test_late_rows_and_latest(spark):
    schema = "key string, ts string, pos int"
    late = T.split_late(spark.createDataFrame([("a", "1", 1), ("a", "3", 2), ("b", None, 3)], schema), spark.createDataFrame([("a", "2", 0)], schema))
    assert [r.pos for r in late[0].collect()] == [2] and sorted(r.pos for r in late[1].collect()) == [1, 3]
    u = spark.sql("select 'k' as key, timestamp'2024-01-01 00:00:00.1' as ts, 1 as pos union all select 'k', timestamp'2024-01-01 00:00:00.3', 2 union all select 'k', timestamp'2024-01-01 00:00:00.9', 3")
    assert sorted(r.pos for r in T.latest_progress(u).collect()) == [2, 3]


def test_deltas_over_eras(spark, tmp_path, monkeypatch):
    from folioframe.streaming import streams

    monkeypatch.setattr(streams, "ERA", 2)
    source, out = tmp_path / "in", str(tmp_path / "out")
    batches = [[("a", 1, 1, "x"), ("b", 1, 1, "y")], [("a", 2, 2, None)], [("a", 3, 3, "z"), ("c", 1, 9, None)], [("b", 0, 5, "old")], [("d", 1, 1, "w")]]
    schema = "path string, mark int, size long, text string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        streams.index_stream(spark.readStream.schema(schema).parquet(str(source)), out, str(tmp_path / "check")).awaitTermination()
    got = {r.path: (r.size, r.text) for r in streams.current_index(spark, out).collect()}
    assert got == {"a": (3, "z"), "b": (1, "y"), "d": (1, "w")}
    assert len(list((tmp_path / "out").glob("era=*"))) == 3


def test_page_tables_lists_and_emphasis(spark):
    from folioframe.sources import files

    html = "<title>T</title><p>a <b>bold</b> and <em>soft</em> <code>x</code></p><ol><li>one<ul><li>in</ul><li>two</ol><table><tr><th>H<th>I<tr><td>1<td><b>2</b></table><table><tr><td>a|b</td></tr><p>end"
    blocks = files.page_blocks(spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>")], "page_id long, html string"))
    got = {r.page_id: r.markdown for r in files.extract_pages(blocks).collect()}
    assert got == {1: "# T\n\na **bold** and *soft* `x`\n\n1. one\n\n  - in\n\n2. two\n\n| H | I |\n| --- | --- |\n| 1 | **2** |\n\nend\n\n| a\\|b |\n| --- |"}


def test_notes_as_references(spark):
    from folioframe.sources import sinks

    notes = spark.createDataFrame([(1, 2, 9, "b", "second"), (1, 1, 3, "a", "first"), (2, 3, 0, "", "only")], "doc int, id int, char_pos int, anchor string, note string")
    meta = spark.createDataFrame([(1, "Title", "Doe", "/x/My Book.pdf"), (2, None, None, None)], "doc int, title string, author string, source string")
    got = {r.doc: r.artefact for r in sinks.write_notes(notes, "bib", meta=meta, year="2024").collect()}
    assert got[1] == "@misc{MyBook,\n  title = {Title},\n  author = {Doe},\n  howpublished = {/x/My Book.pdf},\n  year = {2024},\n  annote = {[a] first; [b] second}\n}\n"
    got = {r.doc: r.artefact for r in sinks.write_notes(notes, "ris", meta=meta, year="2024").collect()}
    assert got[1] == "TY  - GEN\r\nTI  - Title\r\nAU  - Doe\r\nN1  - “a” — first\r\nN1  - “b” — second\r\nUR  - /x/My Book.pdf\r\nPY  - 2024\r\nER  - \r\n" and got[2] == "TY  - GEN\r\nTI  - 2\r\nN1  - only\r\nPY  - 2024\r\nER  - \r\n"


def test_intermediate_tables_are_cleared(spark, tmp_path):
    from pathlib import Path

    from folioframe import session

    session.clear_intermediate(spark)
    frame = session.materialize(spark.range(5), "some")
    folder = Path(frame.inputFiles()[0].removeprefix("file://")).parent
    assert frame.count() == 5 and session.clear_intermediate(spark) == 1 and not folder.exists()
    frame = session.materialize(spark.range(5), "some")
    folder = Path(frame.inputFiles()[0].removeprefix("file://")).parent
    session.discard(frame)
    assert not folder.exists() and session.clear_intermediate(spark) == 0


def test_page_reader_equals_the_standard_parser():
    import random
    from html.parser import HTMLParser

    from folioframe.sources import files

    class Standard(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks = files._Blocks()

        def handle_starttag(self, tag, attrs):
            self.blocks.begin(tag, {k: v or "" for k, v in attrs})

        def handle_endtag(self, tag):
            self.blocks.end(tag)

        def handle_data(self, data):
            self.blocks.say(data)

    pieces = ["<p>", "</p>", "<b>", "</b>", "<i class=x>", "</i>", "<a href='u?a=1&amp;b'>", "</a>", "<li>", "<ul>", "</ul>", "<ol start=3>", "</ol>", "<table>", "<tr>", "<td>", "<th>", "</td>", "</table>", '<h2 id=a b title="x>y">', "</h2>", "<script>", "x &lt; y </script>", "<!-- c -->", "text ", " more&nbsp;t", '<img alt="q" src=s>', "<nav>", "</nav>", "<br/>", "<!DOCTYPE html>", "<pre>", "</pre>", "<blockquote>", "<code>", "</code>", "<figcaption>", "<TITLE>", "</Title >"]
    rng = random.Random(2)
    for _ in range(4000):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 16))) + "</script>"
        standard = Standard()
        standard.feed(html)
        standard.close()
        while standard.blocks.tables:
            standard.blocks.end_table()
        standard.blocks.flush()
        assert files._Blocks().read(html) == standard.blocks.rows


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<b>x", "<p>", "</a ", '<a href="', "&amp;", "<", "<table>", "<script>", "<![CDATA[", "<ul><li>", "<a x='1' "])
def test_page_reader_is_linear(piece):
    from folioframe.sources import files

    began = time.process_time()
    files._Blocks().read(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 6
