"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags and at double line breaks. The
first pass looks at every block by itself. Blocks inside elements that hold no
article text by their meaning (navigation, header and footer outside the
article, sidebar, form, script, style) or by their class or id (advert, cookie
notice, comments) are boilerplate; the others are classified by length, link
density and stop-word density as ``good``, ``bad``, or ambiguous: ``near-good``
and ``short``. Where the page marks an article, that is evidence: what stands in
it and would be bad is ambiguous. The second pass gives ambiguous blocks the
label of their nearest decided neighbours, other than boilerplate by its mark, on
the same side of the article's borders, and, where none is decided there, keeps them in an article and on pages
without any good block. Text outside a marked article that holds good text is no
part of it.

On pages in languages without a stop list here (next to no stop word in all of
the page's unlinked text) length and links decide alone.

Character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by a line end. Nothing else is dropped
or cut. Reading is one pass over the page: a tag that never ends is text, and
from the first attribute value on whose quote is never closed, quotes are not
heeded any more.

Defined cases: null or empty html gives an empty text; unclosed or misnested
tags are read to the end of the page; rows with equal ids are read separately;
input columns named ``text`` or ``n_chars`` give way to the results, other
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a block at their tags.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements whose text is never page text.
SILENT = frozenset("script style noscript template iframe object embed svg canvas math audio video head title textarea select option button".split())
#: Elements whose content holds no tags.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Elements that are boilerplate wherever they stand.
PLAIN = frozenset("nav aside form menu dialog fieldset".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark an element as boilerplate.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|adsense|sponsor|sponsored|promo|promoted|banner|cookie|cookies|consent|gdpr|notice|popup|modal|newsletter|"
    r"subscribe|subscription|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|widget|widgets|footer|foot|header|masthead|topbar|toolbar|comment|comments|commentlist|respond|"
    r"disqus|related|recommended|recommendations|share|sharing|social|login|signup|signin|search|pagination|pager|copyright|disclaimer|skip|hidden)(?:$|[\s_-]|\d)",
    re.I,
)
#: Words of a class or id by which an article is none: teasers, adverts, comments.
NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|sponsored|promo|comment|comments|related|teaser)(?:$|[\s_-]|\d)", re.I)
#: Roles that mark an element as boilerplate.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Frequent words of the languages that pages come in; short list, for density only.
STOP = frozenset(
    "the of and to in is that it as for was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has "
    "der die das und ist von mit den zu ein eine nicht im auf für sich des dem als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et en un une du que est pour dans qui sur pas au par plus avec ce se il sont "
    "el los las que y en un una por con para es del se al lo como más su no".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
LINKS_HIGH = 0.2
STOP_LOW, STOP_HIGH = 0.12, 0.2
#: A page below this share of stop words is in a language without a stop list here.
STOP_ANY = 0.04
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  #: characters inside links
    plain: bool  #: inside a boilerplate element
    article: bool  #: inside the article
    heading: bool
    label: str = ""


_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SIGN = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open item of these kinds ends at the next of its kind, unless one of these was opened in between; an open paragraph ends at any block.
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}


class _Page:
    """The open elements and the blocks found so far.

    An open element is (tag, boilerplate, silent); counts of the open ones of
    each property make a block's state a look-up, and so do the places of the
    open elements of each name and of the block-level ones.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: dict[str, list[int]] = {}
        self.firm: list[int] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = self.plain = self.silent = self.article = self.heading = self.link = 0
        self.broken = False  #: a line break was the last thing read

    def _count(self, element: tuple[str, bool, bool], by: int) -> None:
        tag, plain, silent = element
        self.plain += by * plain
        self.silent += by * silent
        self.article += by * (tag in ("article", "main"))
        self.heading += by * (tag in HEADINGS)
        self.link += by * (tag == "a")

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append(Block(text, self.links, self.plain > 0, self.article > 0, self.heading > 0))
            self.parts, self.links = [], 0

    def pop(self, i: int) -> None:
        for element in reversed(self.stack[i:]):
            self._count(element, -1)
            self.open[element[0]].pop()
            if element[0] in BLOCKS:
                self.firm.pop()
        del self.stack[i:]

    def last(self, tag: str) -> int:
        """The place of the last open element of that name, or -1."""
        at = self.open.get(tag)
        return at[-1] if at else -1

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.broken:
                self.flush()
            self.parts.append(" ")
            self.broken = True
            return
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag in BARRIERS:
            at = self.last(tag)
            if at >= 0 and all(self.last(b) < at for b in BARRIERS[tag]):
                self.pop(at)
        elif tag in BLOCKS and self.firm and self.stack[self.firm[-1]][0] == "p" and (tag == "p" or self.firm[-1] == len(self.stack) - 1):
            self.pop(self.firm[-1])
        plain = tag in PLAIN or tag == "footer" or (tag == "header" and not self.article)
        if not plain and attributes and _TELLING.search(attributes):
            named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            plain = (
                (tag not in ("html", "body", "main") and bool((NO_ARTICLE if tag == "article" else MARKED).search(f"{named.get('class', '')} {named.get('id', '')}")))
                or named.get("role", "").lower() in ROLES
                or "hidden" in named
                or named.get("aria-hidden") == "true"
                or "display:none" in named.get("style", "").replace(" ", "").lower()
            )
        if attributes.endswith("/") and tag not in BLOCKS:
            return
        element = (tag, plain, tag in SILENT)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.firm.append(len(self.stack))
        self.stack.append(element)
        self._count(element, 1)

    def end(self, tag: str) -> None:
        if tag in BLOCKS and tag != "br":
            self.flush()
        at = self.last(tag)
        if at >= 0 and (tag in BLOCKS or not self.firm or self.firm[-1] < at):  # inline elements end inside their block only
            self.pop(at)

    def data(self, text: str) -> None:
        if self.silent or not text:
            return
        if "&" in text:
            text = unescape(text)
        if self.broken and not text.isspace():
            self.broken = False
        self.parts.append(text)
        if self.link:
            self.links += len(text.strip())


def tag_end(html: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Where a tag that is open at ``at`` ends (-1: never), and whether quotes are heeded from here on."""
    begun = at
    while quotes:
        sign = _SIGN.search(html, at)
        if sign is None:
            break
        if sign[0] == ">":
            return sign.end(), True
        before = sign.start() - 1
        while html[before].isspace():
            before -= 1
        if html[before] != "=":  # a quote opens a value only
            at = sign.end()
            continue
        at = html.find(sign[0], sign.end()) + 1
        if not at:
            break
    return html.find(">", begun) + 1 or -1, False


def blocks_of(html: str | None) -> list[Block]:
    """The blocks of a page, in order; anything that is no tag is text."""
    page, html, at, begun, quotes = _Page(), html or "", 0, 0, True
    while True:
        less = html.find("<", at)
        if less < 0:
            break
        if html.startswith(("<!", "<?"), less):  # comments, sections, declarations
            close, skip = ("-->", 2) if html.startswith("<!--", less) else ("]]>", 9) if html.startswith("<![CDATA[", less) else (">", 2)
            end = html.find(close, less + skip)
            page.data(html[begun:less])
            at = begun = len(html) if end < 0 else end + len(close)
            continue
        closing = html.startswith("</", less)
        name = _NAME.match(html, less + 1 + closing)
        if name is None:
            at = less + 1
            continue
        end, quotes = tag_end(html, name.end(), quotes)
        if end < 0:
            break
        page.data(html[begun:less])
        at = begun = end
        tag = name[0].lower()
        if closing:
            page.end(tag)
            continue
        page.start(tag, html[name.end() : end - 1])
        if tag in RAW:  # nothing inside is a tag
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            stop = close.start() if close else len(html)
            page.data(html[at:stop])
            at = begun = stop
    page.data(html[begun:])
    page.flush()
    return page.blocks


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP.__contains__, words)), len(words)


def first_pass(block: Block, density: float | None) -> str:
    """``bad``, ``good``, ``near-good`` or ``short``; without a stop list ``density`` is None."""
    if block.plain:
        return "bad"
    doubtful = "short" if block.article else "bad"
    if block.links > LINKS_HIGH * len(block.text):
        return doubtful
    if len(block.text) < LENGTH_LOW:
        return doubtful if block.links else "short"
    if density is None or density >= STOP_HIGH:
        return "good" if len(block.text) > LENGTH_HIGH else "near-good"
    if density < STOP_LOW and len(block.text) <= LENGTH_HIGH:  # too few words to go by
        return "short"
    return "near-good" if density >= STOP_LOW else doubtful


def second_pass(blocks: list[Block], labels: list[str], alone: str) -> list[str]:
    """Ambiguous blocks get the labels of the nearest decided ones; ``alone`` where there is none."""
    decided = ("good", "bad")
    ahead: list[int | None] = [None] * len(blocks)
    near: int | None = None
    for i in range(len(blocks) - 1, -1, -1):
        ahead[i] = near
        near = i if labels[i] in decided else near
    found, before = [], None
    for i, b in enumerate(blocks):
        after = ahead[i]
        sides = [labels[j] for j in (before, after) if j is not None]
        if labels[i] in decided:
            found.append(labels[i])
            before = i
        elif not sides:
            found.append(alone)
        elif labels[i] == "near-good":
            found.append("good" if "good" in sides else "bad")
        elif b.heading:  # a heading goes with what it heads
            found.append(labels[after] if after is not None else "bad")
        elif len(sides) == 2 and sides[0] != sides[1]:
            found.append(sides[0] if i - before <= after - i else sides[1])
        else:
            found.append(sides[0])
    return found


def classify(blocks: list[Block]) -> list[Block]:
    """Labels every block ``good`` or ``bad``."""
    counts = [(0, 0) if b.plain else stop_words(b.text) for b in blocks]
    stops, words = (sum(c[k] for c, b in zip(counts, blocks, strict=True) if not b.links) for k in (0, 1))
    listed = stops >= STOP_ANY * words
    labels = [first_pass(b, s / max(1, n) if listed else None) for b, (s, n) in zip(blocks, counts, strict=True)]
    #: an element's own mark says nothing about its neighbours
    inside = [i for i, b in enumerate(blocks) if b.article and not b.plain]
    outside = [i for i, b in enumerate(blocks) if not b.article and not b.plain]
    no_good = "good" not in labels
    for zone, alone in ((inside, "good"), (outside, "bad")):
        of_zone = [labels[i] for i in zone]
        if zone is outside and no_good and not inside:  # a page of short blocks: what nothing speaks against
            of_zone = ["bad" if x == "bad" else "good" for x in of_zone]
        for i, label in zip(zone, second_pass([blocks[i] for i in zone], of_zone, alone), strict=True):
            blocks[i].label = label
    article = any(blocks[i].label == "good" for i in inside)
    for i, b in enumerate(blocks):
        if b.plain or (article and not b.article):
            b.label = "bad"
    return blocks


def main_text(html: str | None) -> str:
    """The page's article as one line per block."""
    return "\n".join(b.text for b in classify(blocks_of(html)) if b.label == "good")


def extract_text(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) with ``text`` and ``n_chars`` of the whole html."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*keep, F.col(html).alias("_page_html"))
    return rows.mapInArrow(extract, rows.drop("_page_html").schema.add("text", "string").add("n_chars", "long"))


def op10_extract_text(spark, sf_dir):
    """The main text of every page."""
    from folioframe.session import table

    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
