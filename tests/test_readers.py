"""Numbers, markup, alignment, rare words and long documents."""

import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioframe.functions import markup, numbers
from folioframe.functions import normalize as N
from folioframe.operators import mining as M
from folioframe.operators import shaping as S

DOCS = "doc_id long, text string"


def one(spark, text):
    return spark.createDataFrame([(1, text)], DOCS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("at 9:15 AM", "at nine fifteen AM"), ("15:30 today", "three thirty PM today"), ("9:15 amazing", "nine fifteen AM amazing"), ("v1.2.3", "v1.two point three"), ("1.5-2.5 and 3/4", "1.5-2.5 and 3/4"), ("x_12345", "x_12345"),
        ("$5. ok", "five dollars. ok"), ("$3.5", "three dollars and fifty cents"), ("£1.01", "one pound and one penny"), ("$1.999", "one point nine nine nine dollars"), ("1ST 2Nd 11th", "first second eleventh"), ("99:99 a", "99:99 a"), ("12:345", "12:345"),
        ("1,234%", "1,two hundred thirty-four percent"), ("In 1984.", "In 1984."), ("2024-13-01", "twenty twenty-four-13-01"), ("10.0.0.1", "ten point zero.zero point one"), ("30 pm", "30 pm"), ("", ""),
    ],
)
def test_number_readings(text, want):
    assert numbers.spoken(text) == want


SAMPLES = {
    "iso_date": ["2024-03-15", "1999-12-31"], "us_date": ["03/15/2024", "1/2/1999"], "time": ["12:00", "3:45 PM", "23:59:59"], "money": ["$1,234.56", "£7", "€0.50"], "percent": ["75%", "3.5%"], "ordinal": ["1st", "22ND"],
    "grouped": ["1,234,567"], "decimal": ["3.14", "0.5"], "plain": ["1984", "50000"], "": ["12", "7", "x9", "3/4", "12-13", "9:99"],
}


def test_number_kinds_by_brute_force(spark):
    r, texts, parts_of, want = random.Random(5), [], {}, {}
    for i in range(300):
        parts_of[i] = []
        for _ in range(r.randrange(12)):
            kind = r.choice(list(SAMPLES))
            literal = r.choice(SAMPLES[kind])
            parts_of[i] += [(literal, kind), (r.choice(("word", "of", "é,", "(and)")), "")]
            if kind:
                want[kind, literal] = want.get((kind, literal), 0) + 1
        texts.append((i, " ".join(p for p, _ in parts_of[i])))
    rows = N.number_table(spark.createDataFrame([*texts, (-1, None)], DOCS)).collect()
    assert {(x.kind, x.literal): x["count"] for x in rows} == want
    words = {x.literal: x.words for x in rows}
    assert all(N.say_number(k) == v for k, v in words.items()) and not any(any(c.isdigit() for c in w) for w in words.values())
    for x in N.verbalize_numbers(spark.createDataFrame(texts, DOCS)).collect():
        assert x.text == " ".join(words[p] if kind else p for p, kind in parts_of[x.doc_id])


def test_markdown_by_its_rules():
    plain = markup.plain_markdown
    md = "# Heading\n\nSome **bold** and *italic* and `code` text.\n\n- item one\n- item two\n\n> a quote\n\n[link](http://x.com)\n\n```python\nprint(1)\n```\n"
    assert plain(md) == "Heading\n\nSome bold and italic and code text.\n\nitem one item two\n\na quote\n\nlink"
    assert plain("```\nkeep me\n```", skip_code=False) == "keep me" and plain("Paragraph.\n\n    x = c()\n\nAfter.\n") == "Paragraph.\n\nAfter."
    assert plain("> quoted\n>> nested quote\n> > spaced nested\n") == "quoted nested quote spaced nested"
    assert plain("| A | B |\n|---|:-:|\n| 1 | 2 |\ntext") == "Row 1: A is 1, B is 2. text" and plain("| A |\n|---|") == "A."
    assert plain("a*b* _x_y_ snake_case_name ***x*** `co*de* x` \\*no\\*") == "ab x_y snake_case_name x co*de* x *no*"
    assert plain("[a [b](c) d](e) ![alt](src) [open](") == "a b d alt [open](" and plain("***\n2 * 3 * 4\n## H ##") == "2 * 3 * 4 H" and plain("") == ""


def test_wikis_by_their_rules():
    of = lambda t, d: markup.markdown_of(t, d)[0]
    assert of("{{{\n**x** = y\n}}}\n|=H|=I|\n|a|//b//|\n|[[u|l]]|x|\nhttp://x.y//z\n== H\n[[Link|text]]", "creole") == "```\n**x** = y\n```\n| **H** | **I** |\n| a | *b* |\n| [l](u) | x |\nhttp://x.y//z\n## H\n[text](Link)"
    assert of("pre. a *b*\n* item *x*\nh1. Heading\n**bold** __em__\np. text", "textile") == "```\na *b*\n```\n* item **x**\n# Heading\n**bold** *em*\ntext"
    assert of("! A !! B\n|-\n| a || b\n'''''x'''''\n* item\n=== Sub ===\nl'homme d'or\n[[Link]]", "mediawiki") == "| A | B\n| a | b\n***x***\n* item\n## Sub\nl'homme d'or\nLink"


@pytest.mark.parametrize("text", ["*a " * 100_000, "[a " * 100_000, "_" * 200_000, "`a " * 100_000, "1.2" * 100_000, "1," * 100_000, "'''a ''" * 40_000, "[a](" * 50_000], ids=range(8))
def test_readers_are_linear(text):
    began = time.perf_counter()
    markup.plain_markdown(text), numbers.spoken(text), markup.markdown_of(text, "mediawiki")
    assert time.perf_counter() - began < 10


def test_long_documents_are_linear(spark):
    def seconds(n):
        docs = one(spark, "Some words here. And more of them. " * n)
        words = docs.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n_words")).withColumn("block_starts", F.sequence(F.lit(0), F.col("n_words"), F.lit(40)))
        began = time.perf_counter()
        S.paginate(words, words_per_page=200).count(), S.chunk_text(docs, limit=800).count(), S.pack_cues(docs, F.lit(1.0)).count()
        return time.perf_counter() - began

    seconds(100)
    assert seconds(12_000) < 30


def test_rare_words_fill_up_cards(spark):
    zipf = spark.createDataFrame([("glacier", 3.0), ("moraine", 2.0), ("slowly", 4.4), ("moves", 5.0), ("unseen", 0.0)], "word string, zipf double")
    docs = one(spark, "A glacier moves slowly past its moraine. Rome and Paris met Oslo near Bern in 1900 by a glacier.")
    got = {r.n: r.terms for r in M.cloze_cards(docs, frequencies=zipf).collect()}
    assert got == {0: ["glacier", "slowly", "moraine"], 1: ["Rome and Paris", "Oslo", "Bern"]}
    assert M.cloze_cards(docs, frequencies=zipf, most=1).filter("n = 0").first().terms == ["moraine"]


def test_alignment_anchors_again():
    spoken = "table with 2 columns row 1 name is alice age is 30 the end".split()
    shown = "name age alice 30 the end".split()
    got = M.filled_places(M.matched_places(spoken, shown))
    assert [shown[got[i]] for i in (8, 11, 12, 13)] == ["alice", "30", "the", "end"]
    # four spoken words that are not shown, then text that both have
    assert M.matched_places(list("wxyzab"), list("qrstab")) == [None] * 4 + [4, 5]
    assert M.matched_places([], ["a"]) == [] and M.matched_places(["a"], []) == [None]
    assert M.matched_places("a x b c".split(), "a q a x b d".split()) == [2, 3, 4, None] or M.matched_places("a x b c".split(), "a q a x b d".split()) == [0, 3, 4, None]


@given(st.lists(st.sampled_from("abcdef"), max_size=30), st.lists(st.sampled_from("abcdef"), max_size=30))
def test_alignment_is_rising_and_equal(spoken, shown):
    got = M.matched_places(spoken, shown)
    pairs = [(i, j) for i, j in enumerate(got) if j is not None]
    assert all(spoken[i] == shown[j] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs})
    assert bool(pairs) == bool(set(spoken) & set(shown)) and (spoken != shown or got == list(range(len(spoken))))


@pytest.mark.parametrize("n", [3, 2000])
def test_alignment_of_insertions_only(n):
    rng = random.Random(n)
    for few in (3, 10**6):  # hardly a word stands alone, or nearly all do
        shown = [f"w{rng.randrange(few)}" for _ in range(n)]
        spoken, want = [], []
        for i, w in enumerate(shown):
            if rng.random() < 0.1:
                spoken += ["<row>"] * rng.randint(1, 4)
            want.append(len(spoken))
            spoken.append(w)
        got = M.matched_places(spoken, shown)
        assert [got[i] for i in want] == list(range(n)) or few == 3 and sum(g is not None for g in got) > 0.97 * n


def test_alignment_of_repeating_texts_ends():
    for spoken, shown in ((["a", "b"] * 10_000, ["b", "a", "c"] * 7_000), (["x"] * 20_000, ["x"] * 21_000 + ["y"]), (list("abcab") * 5_000, list("bcaba") * 5_000)):
        began = time.process_time()
        got = M.matched_places(["<"] + spoken, shown)
        assert time.process_time() - began < 5 and sum(g is not None for g in got) > 6_000
    words = [f"w{i % 977}" for i in range(110_000)]
    began = time.process_time()
    got = M.matched_places(["table", "with", *words[:50_000], "row", *words[50_000:]], words)
    assert time.process_time() - began < 10 and got[2] == 0 and got[-1] == len(words) - 1


def test_summaries_of_long_documents_in_blocks():
    parts = [f"Sentence {i} speaks of topic{i % 7} and item{i}." for i in range(400)]
    whole, packed = M.sentence_links(parts, 0.1), M.sentence_links(parts, 0.1, cells=1 << 12)
    import numpy as np

    assert len(packed) > 10 and (np.concatenate([np.unpackbits(b, axis=1, count=400) for b in packed]).astype(bool) == np.concatenate(whole)).all()
    began = time.perf_counter()
    assert abs(M.lexrank(parts * 8).sum() - 1) < 1e-9 and time.perf_counter() - began < 20


def test_numbers_of_any_length():
    nines = "9" * 5000
    assert numbers.spoken(nines) == nines and numbers.spoken(f"${nines}.05") == f"{nines} dollars and five cents" and numbers.spoken(f"{nines}th") == f"{nines}th"
    assert numbers.spoken(f"{nines}% 1,{','.join(['999'] * 2000)} 5.{nines[:6]}").startswith(f"{nines} percent 1999")
    assert numbers.spoken("0001984 $0.00 $01.10") == "nineteen eighty-four zero dollars one dollar and ten cents"
