import re
import time
from html import unescape

import pytest

from folioframe.llm import html_text as H
from folioframe.session import table

LONG = "This is the story of a town that was built by the river and of the people who have lived in it for a long time."
PAGES = "page_id long, url string, html string"


def test_article_without_boilerplate():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
    <header>Site</header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">{LONG}</div>
    <article><h1>Head &amp; Line</h1><p>{LONG}<p>Short&nbsp;one.<br>Next\n line.</p><ul><li>a<li>b</ul><form>Search <input></form>
    <div id=comments><p>{LONG}</p></div><aside>{LONG}</aside><!-- <p>hidden</p> --><p><a href=x>one link</a></p></article>
    <div class="ad banner">{LONG}</div><footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == f"Head & Line\n{LONG}\nShort one. Next line.\na\nb\none link"


def test_two_passes_without_an_article_element():
    good = f"{LONG} {LONG} {LONG}"
    page = f"<body><div>Menu</div><div><a href=a>A</a> | <a href=b>B</a></div><h2>Title</h2><p>{good}</p><p>Short inside.</p><p>{good}</p><div><a href=x>Privacy</a></div><p>x 123</p></body>"
    assert H.main_text(page) == f"Title\n{good}\nShort inside.\n{good}"


def test_awkward_markup():
    for page in (None, "", "<", "<p", "plain", "<p>" * 5000, "<a href='x>y", "a < b <c", "<!-- open", "<script>open", "</p></div>", "<div " + "x='1' " * 3000 + ">t</div>"):
        H.main_text(page)
    assert H.main_text("<article><p>1 < 2 &lt;b&gt; &#233;</article>") == "1 < 2 <b> é"


def article_of(html):
    inside = html[html.index("<article>") + 9 : html.index("</article>")]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_query_keeps_the_article_of_every_page(spark):
    got = {r.page_id: r for r in H.op10_extract_text(spark, "/root/testdata/sf0.01").collect()}
    rows = table(spark, "/root/testdata/sf0.01", "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_of(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_the_passes_find_the_article_without_its_tags(spark):
    rows = table(spark, "/root/testdata/sf0.01", "pages").collect()
    wrong = [r.page_id for r in rows if H.main_text(re.sub("</?article>", "", r.html)) != article_of(r.html)]
    assert len(wrong) <= 0.04 * len(rows)  # articles that hold menus or next to no stop words


def test_both_passes_run_inside_an_article():
    blocks = H.classify(H.blocks_of(f"<article><h2>One</h2><p>{LONG} {LONG}</p><p><a href=x>linked</a></p></article><p>{LONG} {LONG}</p>"))
    assert [H.first_pass(b, 0.3) for b in blocks] == ["short", "good", "short", "good"]
    assert [b.label for b in blocks] == ["good", "good", "good", "bad"]


def test_languages_without_a_stop_list():
    good = "Ez egy hosszabb szöveg arról, hogyan épült fel egy kisváros folyóparti negyede, miután elvonultak onnan vendégei. " * 3
    page = f"<div>Menü</div><div><a href=a>Kapcsolat</a></div><h2>Cím</h2><p>{good}</p><p>Rövid.</p><p>{good}</p><div><a href=x>Adatvédelem</a></div>"
    assert H.main_text(page) == f"Cím\n{good.strip()}\nRövid.\n{good.strip()}"


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<b "' * 250_000, "<b x='" * 160_000 + ">", "<b>" * 170_000 + "</i>" * 170_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 150_000, "<td><dt>" * 100_000, "<p>x" * 250_000, "<div>short</div>" * 60_000, "<!" * 500_000, "<" * 1_000_000, "<p><a x=" + " " * 1_000_000],
    ids=range(11),
)
def test_reading_is_linear(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 5


def test_one_megabyte_of_open_tags_in_a_second():
    began = time.perf_counter()
    assert H.main_text("<a " * 350_000) == ("<a " * 350_000).strip()
    assert time.perf_counter() - began < 1


def test_rows(spark):
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", "", 2), (None, None, "<p>" + LONG, 3)], PAGES + ", text long")
    got = H.extract_text(odd).orderBy("n_chars").collect()
    assert [r.text for r in got] == ["", "", LONG] and H.extract_text(odd.limit(0)).count() == 0
