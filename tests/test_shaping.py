"""Pinned cases and invariants of text shaping, mining and normalisation."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import normalize as N
from folioframe.operators import mining as M
from folioframe.operators import shaping as S
from folioframe.session import table

DOCS = "doc_id long, text string"


def one(spark, text):
    return spark.createDataFrame([(1, text)], DOCS)


def test_sentences_have_true_offsets(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = S.sentence_spans(docs).collect()
    assert rows and all(texts[r.doc_id][r.start : r.end] == r.sentence for r in rows)
    got = [r.sentence for r in S.sentence_spans(one(spark, " One here. Two? \"Three!\"\nfour.\n\nFive")).orderBy("n").collect()]
    assert got == ["One here.", "Two?", '"Three!"\nfour.', "Five"] and S.sentence_spans(one(spark, None)).count() == 0


def test_timings_tile_the_duration(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    for frame in (S.allocate_time(docs, F.lit(10.0)), S.sentence_timing(docs, F.lit(10.0)), S.pack_cues(docs, F.lit(10.0))):
        rows = sorted((r.doc_id, r.n, r.start_s, r.end_s) for r in frame.collect())
        for a, b in zip(rows, rows[1:], strict=False):
            assert abs((b[2] - a[3]) if a[0] == b[0] else b[2]) < 1e-9
        assert max(abs(e - 10) for d, e in {r[0]: r[3] for r in rows}.items()) < 1e-9


def test_cues_break_at_limits_and_sentences(spark):
    got = [r.cue for r in S.pack_cues(one(spark, "A b c. D e " + "word " * 14), F.lit(1.0)).orderBy("n").collect()]
    assert got[0] == "A b c." and got[1].startswith("D e word") and len(got[1].split()) == 12 and len(got) == 3
    assert all(len(c) <= 90 for c in [r.cue for r in S.pack_cues(one(spark, "abcdefgh " * 60), F.lit(1.0)).collect()])


def test_pages_tile(spark):
    docs = spark.createDataFrame([(1, 10_000, list(range(0, 10_000, 40))), (2, 0, [0]), (3, 10, [0, 5])], "doc_id long, n_words int, block_starts array<int>")
    pages = {}
    for r in S.paginate(docs).orderBy("doc_id", "page").collect():
        pages.setdefault(r.doc_id, []).append((r.start, r.end))
    assert len(pages[1]) == 9 and pages[1][0] == (0, 1200) and pages[1][-1][1] == 10_000 and pages[2] == [(0, 0)] and pages[3] == [(0, 10)]
    assert all(a[1] == b[0] for a, b in zip(pages[1], pages[1][1:], strict=False))
    words = spark.createDataFrame([(1, -5), (1, 1199), (1, 1200), (1, 99_999)], "doc_id long, word int")
    assert {r.word: r.page for r in S.page_of_word(S.paginate(docs), words).collect()} == {-5: 0, 1199: 0, 1200: 1, 99_999: 8}


@pytest.mark.parametrize("text", ["\n\n".join("Sentence one. " * 30 for _ in range(20)).strip(), "Long one. " * 1200, "x" * 12_000, "a\n\n\n\nb", "short", "\n\n" + "y" * 4500 + "\n\nend"])
def test_chunks_rejoin(spark, text):
    rows = S.chunk_text(one(spark, text)).orderBy("n").collect()
    assert all(len(r.chunk) <= 4500 for r in rows) and " ".join("".join(r.chunk + r.sep for r in rows).split(" ")).rstrip() == text.rstrip()


def test_chapters_outline_tables_notes(spark):
    md = "Lead.\n# One #\nBody\n## Two\n\n# One\nMore"
    got = [(r.chapter, r.title, r.body) for r in S.split_chapters(one(spark, md).withColumn("title", F.lit("Doc"))).orderBy("chapter").collect()]
    assert got == [(0, "Doc", "Lead."), (1, "One", "One\nBody"), (2, "Two", "Two"), (3, "One", "One\nMore")]
    assert [(r.level, r.title, r.occurrence) for r in S.outline(one(spark, md)).orderBy("n").collect()] == [(1, "One", 1), (2, "Two", 1), (1, "One", 2)]
    assert S.split_chapters(one(spark, " \n ").withColumn("title", F.lit("Doc"))).count() == 0
    t = "| Name | Age | City |\n|---|:-:|---|\n| Alice | 30 | New York |\n| Bob | | Boston |\n\nx\n| Q |\n|---|\n| 1 |"
    facts = {(r.table, r.row, r.header): r.cell for r in S.table_rows(one(spark, t)).collect()}
    assert facts[1, 1, "City"] == "New York" and facts[1, 2, "Age"] == "Boston" and facts[2, 1, "Q"] == "1"
    assert S.narrate_tables(one(spark, t)).filter("table = 1").first().narration == "Row 1: Name is Alice, Age is 30, City is New York.\nRow 2: Name is Bob, Age is Boston."
    assert S.narrate_tables(one(spark, t), "flat").filter("table = 2").first().narration == "1." and "1 column," in S.narrate_tables(one(spark, t), "skip").filter("table = 2").first().narration
    notes = one(spark, "See[^1] and[^x] and[^no].\n[^1]: first\n[^x]: old\n[^x]: new")
    assert S.footnotes(notes).first().text == "See (first) and (new) and."
    assert S.footnotes(notes, "deferred").first().text == "See [1] and [x] and.\n\nFootnotes:\n1. first\n2 (x). new" and S.footnotes(notes, "skip").first().text == "See and and."


def test_block_context_and_offsets(spark):
    got = {r.n: r for r in S.block_context(one(spark, "# H\ntext\n\n| a |\n| b |\n\n## K\nend")).collect()}
    assert got[1].prev_heading == 0 and got[1].next_heading == 6 and got[1].next_table == 3 and got[7].prev_table == 3 and got[0].prev_heading is None and got[7].next_paragraph == 7
    tokens = S.tokens_of(one(spark, "ab  cd\nef"))
    assert [(r.word, r.start, r.end) for r in tokens.orderBy("idx").collect()] == [("ab", 0, 2), ("cd", 4, 6), ("ef", 7, 9)]
    ask = spark.createDataFrame([(1, 0), (1, 1), (1, 7), (1, 99)], "doc_id long, offset int")
    assert {r.offset: r.idx for r in S.word_at_offset(tokens, ask).collect()} == {0: 0, 1: 1, 7: 2, 99: 2}
    spans = S.valid_spans(spark.createDataFrame([(1, 3, 5), (1, 6, 6), (1, 7, 99)], "doc_id long, start int, end int"), one(spark, "ab  cd\nef"))
    hard = spark.createDataFrame([(1, "cd"), (1, "ef")], "doc_id long, word string")
    assert {r.word: r.kind for r in S.highlight_words(tokens, spans, hard).collect()} == {"cd": "user", "ef": "difficult"}


def test_reading_order(spark):
    schema = "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double, page_w double"
    two = [("TITLE", 50, 700, 550, 740), ("L1", 50, 600, 250, 690), ("R1", 350, 600, 550, 690), ("FIG", 50, 400, 550, 500), ("L2", 50, 300, 250, 390), ("R2", 350, 300, 550, 390), (" ", 0, 0, 1, 1)]
    rows = [(1, 1, t, float(a), float(b), float(c), float(d), 600.0) for t, a, b, c, d in two] + [(1, 2, t, 50.0, y - 10.0, 250.0, y, 600.0) for t, y in (("b", 100.0), ("a", 200.0))]
    got = [(r.page, r.text) for r in S.reading_order(spark.createDataFrame(rows[::-1], schema)).orderBy("page", "position").collect()]
    assert got == [(1, "TITLE"), (1, "L1"), (1, "R1"), (1, "FIG"), (1, "L2"), (1, "R2"), (2, "a"), (2, "b")]


def test_recurring_lines(spark):
    rows = spark.createDataFrame([("g", p, line) for p in range(4) for line in (f"Page {p}", f"body {'abcd'[p]}")], "grp string, page int, line string")
    found = S.recurring_lines(rows, group="grp", member="page")
    assert [r.key for r in found.collect()] == ["page #"] and S.without_lines(rows, found, group="grp").count() == 4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Meeting on 2024-03-15 today.", "Meeting on March fifteenth, twenty twenty-four today."), ("Due 03/15/2024 ok.", "Due March fifteenth, twenty twenty-four ok."), ("at 12:00", "at noon"), ("at 00:00", "at midnight"), ("at 15:30", "at three thirty PM"),
        ("at 3:45 PM", "at three forty-five PM"), ("at 00:30", "at zero thirty AM"), ("costs $1,234.56 total", "costs one thousand two hundred thirty-four dollars and fifty-six cents total"), ("$1.00", "one dollar"), ("$0.50", "fifty cents"),
        ("75% and 3.5%", "seventy-five percent and three point five percent"), ("the 1st and 22nd", "the first and twenty-second"), ("1,234,567 people", "one million two hundred thirty-four thousand five hundred sixty-seven people"),
        ("pi is 3.14", "pi is three point one four"), ("year 1984 here", "year nineteen eighty-four here"), ("value 50000 ok", "value fifty thousand ok"), ("plain 12 stays", "plain 12 stays"), (None, None),
    ],
)
def test_numbers(spark, text, want):
    assert N.verbalize_numbers(one(spark, text)).first().text == want


def test_markdown_lexicon_wiki(spark):
    md = "# T\n\n- *one* **two**\n    - nested\n\n```\ncode\n```\n> quoted [link](u) ![i](p)\nsoft\nbreak"
    assert one(spark, md).select(N.strip_markdown(F.col("text")).alias("t")).first().t == "T\n\none two nested\n\nquoted link i soft break"
    docs = one(spark, "Dr. No and dr. Who cost $5 of the THE")
    got = N.normalize_corpus(docs, abbreviations={"Dr.": "Doctor"}, lexicon={"the": "$a\\b"}).first()
    assert got.text == "Doctor No and dr. Who cost five dollars of $a\\b $a\\b" and got.changed
    wiki = {
        "mediawiki": ("== T ==\n{|\n'''b''' ''i'' [[P|d]] [[Q]] {{x}}[[File:a.png]][http://a b]", "# T\n**b** *i* d Q b"),
        "creole": ("== T ==\n----\n//i// [[u|l]] {{p|a}} {{{c}}}\n# one", "## T\n---\n*i* [l](u) ![a](p) `c`\n1. one"),
        "textile": ("h2. T\nbq. q\n*b* _i_ @c@ \"l\":http://u\n# one", "## T\n> q\n**b** *i* `c` [l](http://u)\n1. one"),
    }
    for dialect, (text, want) in wiki.items():
        assert N.wiki_to_markdown(one(spark, text), dialect).first().text == want
        assert N.wiki_rule_hits(one(spark, text), dialect).count() > 3


def test_mining(spark):
    text = "Alpha Beta spoke. We saw Marie Curie at New York City in 1903. Section 12 applies to Aspirin."
    spans = M.concept_spans(one(spark, text), "legal").collect()
    assert {(r.text, r.label) for r in spans} == {("Marie Curie", "CONCEPT"), ("New York City", "CONCEPT"), ("Section 12", "LAW")} and all(text[r.start : r.end] == r.text for r in spans)
    cards = M.cloze_cards(one(spark, "Marie Curie won the Nobel Prize in 1903. nothing here. The Nile is long."))
    got = {r.n: (r.front, r.terms) for r in cards.collect()}
    assert got[0] == ("_____ won the _____ in _____. nothing here.", ["Marie Curie", "Nobel Prize", "1903"]) and got[1] == ("The _____ is long.", ["Nile"])
    assert "{{c1::Nile}}" in M.cloze_cards(one(spark, "The Nile is long."), numbered=True).first().front and M.cloze_cards(one(spark, "all lower case here.")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a x b y", "q a b z"), (3, "u v", "w")], "doc_id long, spoken string, rendered string")
    got = {}
    for r in M.align_tokens(docs).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.offset)
    assert got == {1: [0, 1, 2, 3], 2: [1, 2, 2, 2], 3: [0, 0]}


def test_summary_scores_are_a_distribution(spark):
    parts = ["Red cats sleep.", "Red cats chase grey mice.", "Grey mice eat cheese.", "A dog barked loudly."]
    score = M.lexrank(parts)
    assert abs(score.sum() - 1) < 1e-9 and score.argmax() == 1
    got = {r.doc_id: r.summary for r in M.summarize(spark.createDataFrame([(1, " ".join(parts)), (2, ""), (3, None)], DOCS), n=2).collect()}
    assert got[2] == got[3] == "" and "Red cats chase grey mice." in got[1]
