"""Markup read line by line and mark by mark, after the formats' public specifications.

Each format has a reader of lines (headings, lists, quotes, rules, tables,
code) and a table of inline marks. Inline text is read once from left to right;
a mark without its end is text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An inline mark: its name, how it opens and closes, and what becomes of what it holds.
Mark = tuple[str, str, str, Callable[[str], str]]
_LIST = re.compile(r"(?:[-*+]|[0-9]{1,9}[.)])[ \t]+")


class Inline:
    """A reader of inline marks; where several open at a place, the first listed one that closes counts."""

    def __init__(self, marks: list[Mark], escape: str = "") -> None:
        self.marks, self.escape = marks, escape
        self.opening = sorted({m[1][0] for m in marks} | set(escape))

    def read(self, text: str, seen: Counter | None = None) -> str:
        if not any(c in text for c in self.opening):
            return text
        out: list[str] = []
        at, n = 0, len(text)
        missing: set[str] = set()  # ends that no longer occur
        while at < n:
            c = text[at]
            if c == self.escape and at + 1 < n and not text[at + 1].isalnum() and not text[at + 1].isspace():
                out.append(text[at + 1])
                at += 2
                continue
            for name, begin, end, make in self.marks:
                if c != begin[0] or not text.startswith(begin, at) or (begin, end) in missing:
                    continue
                found = self._inside(text, at, begin, end)
                if found is None:
                    missing.add((begin, end))
                elif found:
                    inner, at = found
                    out.append(make(inner if name in RAW else self.read(inner, seen)))
                    if seen is not None:
                        seen[name] += 1
                    break
            else:
                out.append(c)
                at += 1
        return "".join(out)

    def _inside(self, text: str, at: int, begin: str, end: str) -> tuple[str, int] | tuple[()] | None:
        """What a mark at ``at`` holds and where it ends; empty if it doesn't open here, None if no end is left."""
        start = at + len(begin)
        if begin == end and (text[start : start + 1].isspace() or text.startswith(begin[-1], start)):
            return ()
        if begin[0] == "_" and at and text[at - 1].isalnum():
            return ()
        if begin == "//" and at and text[at - 1] == ":":
            return ()
        stop = text.find(end, start + 1)
        while stop >= 0 and begin == end and (text[stop - 1].isspace() or (end[0] == "_" and text[stop + len(end) : stop + len(end) + 1].isalnum()) or (end == "//" and text[stop - 1] == ":")):
            stop = text.find(end, stop + 1)
        if stop < 0:
            return None
        if begin == end:  # of a longer run the last marks close
            while text.startswith(end[-1], stop + len(end)):
                stop += 1
        return text[start:stop], stop + len(end)


#: Marks that hold plain text.
RAW = frozenset(("code", "template", "image", "wikilink", "outlink", "nowiki"))


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


# ---- Markdown


_MARKDOWN = Inline([
    ("code", "```", "```", str.strip), ("code", "``", "``", str.strip), ("code", "`", "`", str.strip),
    ("strong", "***", "***", str), ("strong", "___", "___", str), ("strong", "**", "**", str), ("strong", "__", "__", str), ("emphasis", "*", "*", str), ("emphasis", "_", "_", str),
], "\\")
_RULE = re.compile(r"([*_-])[ \t]*(?:\1[ \t]*){2,}")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?")


def _links_off(text: str) -> str:
    """``[text](address)`` and ``![text](address)`` as their text, inner ones first."""
    if "](" not in text:
        return text
    out: list[str] = []
    open_at: list[int] = []
    at = 0
    while at < len(text):
        c = text[at]
        close = text.find(")", at) if c == "]" and text.startswith("](", at) and open_at else -1
        if close >= 0:
            begun = open_at.pop()
            inner = out[begun + 1 :]
            del out[begun - 1 if begun and out[begun - 1] == "!" else begun :]
            out += inner
            at = close + 1
            continue
        if c == "[":
            open_at.append(len(out))
        out.append(c)
        at += 1
    return "".join(out)


def _narrated(rows: list[str]) -> list[str]:
    """A table's rows as sentences, its first row naming the columns."""
    cells = [[c for c in _cells(r) if c] for r in rows if not (_DELIMITER.fullmatch(r.strip()) and "-" in r)]
    head = cells[0] if cells else []
    named = lambda i: head[i] if i < len(head) else f"Column {i + 1}"
    said = [f"Row {n}: " + ", ".join(f"{named(i)} is {c}" for i, c in enumerate(row)) + "." for n, row in enumerate(cells[1:], 1) if row]
    return said or [". ".join(head) + "." if head else ""]


def plain_markdown(md: str, skip_code: bool = True) -> str:
    """Plain text of Markdown: paragraphs in one line each, tables as sentences."""
    paragraphs: list[list[str]] = [[]]
    table: list[str] = []
    fence, in_code = "", False
    text_line = lambda s: _MARKDOWN.read(_links_off(s)).strip()

    def end_table() -> None:
        if table:
            paragraphs[-1].extend(map(text_line, _narrated(table)))
            table.clear()

    for line in md.split("\n"):
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            elif not skip_code:
                paragraphs[-1].append(bare)
            continue
        if bare[:3] in ("```", "~~~") and (bare[0] == "~" or "`" not in bare.lstrip("`")):
            end_table()
            fence = bare[: len(bare) - len(bare.lstrip(bare[0]))]
            continue
        if not bare:
            end_table()
            paragraphs.append([])
            continue
        item = _LIST.match(bare)
        fresh = not paragraphs[-1]
        indented = line.startswith(("    ", "\t")) and not item
        in_code = indented and (fresh or in_code)
        if in_code and skip_code:
            continue
        if bare.startswith("|"):
            table.append(bare)
            continue
        end_table()
        if _RULE.fullmatch(bare):
            continue
        while item or bare.startswith(">"):
            bare = bare[item.end() :] if item else bare[1:].lstrip()
            item = _LIST.match(bare)
        level = len(bare) - len(bare.lstrip("#"))
        if 1 <= level <= 6 and bare[level : level + 1] in ("", " ", "\t"):
            bare = re.sub(r"(?:^|[ \t]+)#+$", "", bare[level:].strip())
        paragraphs[-1].append(text_line(bare))
    end_table()
    return "\n\n".join(filter(None, (" ".join(filter(None, p)) for p in paragraphs)))


def strip_markdown(text: Column, *, skip_code: bool = True) -> Column:
    """Plain text of Markdown; a table's cells become sentences. Texts without a sign of markup stay in the JVM."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else plain_markdown(t, skip_code))

    marked = text.rlike(r"[\n*_`#>|\[\]\\~+-]|[0-9][.)]\s")
    return F.when(marked, plain(F.when(marked, text))).otherwise(F.trim(text))


# ---- wikis


def _wikilink(inner: str) -> str:
    target, _, shown = inner.partition("|")
    return "" if target.split(":")[0].strip().lower() in ("file", "image", "media") and ":" in target else shown or target


def _named(inner: str, before: str = "") -> str:
    """A Markdown link or picture from ``address|text``."""
    address, bar, shown = inner.partition("|")
    return f"{before}[{shown if bar or before else address}]({address})"


_QUOTED_LINK = re.compile(r'"([^"\n]+)":(https?://[^\s]+)')
#: Inline marks of each dialect, longer ones first.
DIALECTS = {
    "mediawiki": Inline([
        ("nowiki", "<nowiki>", "</nowiki>", str), ("template", "{{", "}}", lambda s: ""), ("wikilink", "[[", "]]", _wikilink), ("outlink", "[http", "]", lambda s: s.partition(" ")[2].strip()),
        ("strong emphasis", "'''''", "'''''", "***{}***".format), ("strong", "'''", "'''", "**{}**".format), ("emphasis", "''", "''", "*{}*".format),
    ]),
    "creole": Inline([
        ("nowiki", "{{{", "}}}", "`{}`".format), ("image", "{{", "}}", lambda s: _named(s, "!")), ("wikilink", "[[", "]]", _named), ("strong", "**", "**", "**{}**".format), ("emphasis", "//", "//", "*{}*".format),
    ], "~"),
    "textile": Inline([
        ("code", "@", "@", "`{}`".format), ("strong", "**", "**", "**{}**".format), ("emphasis", "__", "__", "*{}*".format), ("strong", "*", "*", "**{}**".format), ("emphasis", "_", "_", "*{}*".format),
    ]),
}
_TEXTILE_BLOCK = re.compile(r"(h[1-6]|bq|p|pre)\. +(.*)")


def _heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading between equals signs, the closing ones optional."""
    level = len(line) - len(line.lstrip("="))
    title = line[level:].strip().rstrip("=").strip()
    return (level, title) if 1 <= level <= 6 and title else None


def _mediawiki(line: str, read: Callable[[str], str], seen: Counter) -> list[str]:
    head = _heading(line) if line.startswith("==") and line.rstrip().endswith("==") else None
    if head:
        seen["heading"] += 1
        return ["#" * max(1, head[0] - 1) + " " + head[1]]
    if line.startswith(("{|", "|}", "|+", "|-")):  # a table's frame
        seen["table"] += 1
        return []
    if line[:1] in ("!", "|"):
        seen["table"] += 1
        return ["| " + " | ".join(c.strip() for c in re.split(r"\|\||!!", read(line.lstrip("!|"))))]
    return [read(line)]


def _creole(line: str, read: Callable[[str], str], seen: Counter) -> list[str]:
    bare = line.strip()
    if bare in ("{{{", "}}}"):
        seen["code"] += 1
        return ["```"]
    head = _heading(line)
    if head:
        seen["heading"] += 1
        return ["#" * head[0] + " " + head[1]]
    if len(bare) >= 4 and not bare.strip("-"):
        seen["rule"] += 1
        return ["---"]
    depth = len(line) - len(line.lstrip("#"))
    if depth and line[depth : depth + 1].isspace():
        seen["item"] += 1
        return ["1. " * depth + read(line[depth:].lstrip())]
    if len(line) > 1 and line.startswith("|") and line.rstrip().endswith("|"):
        seen["table"] += 1
        shown = read(line.rstrip()) if "[[" in line or "{{" in line else line
        return ["| " + " | ".join(f"**{c[1:].strip()}**" if c.startswith("=") else read(c) for c in _cells(shown)) + " |"]
    return [read(line)]


def _textile(line: str, read: Callable[[str], str], seen: Counter) -> list[str]:
    block = _TEXTILE_BLOCK.fullmatch(line)
    kind, rest = block.groups() if block else ("", line)
    if kind:
        seen["block"] += 1
    if kind == "pre":
        return ["```", rest, "```"]
    depth = len(rest) - len(rest.lstrip("*#"))
    if depth and rest[depth : depth + 1] == " " and not kind:
        seen["item"] += 1
        return [("* " if rest[0] == "*" else "1. ") + _linked(rest[depth:].lstrip(), read, seen)]
    before = {"h": "#" * int(kind[1]) + " " if kind[:1] == "h" else "", "b": "> "}.get(kind[:1], "")
    return [before + _linked(rest, read, seen)]


def _linked(text: str, read: Callable[[str], str], seen: Counter) -> str:
    """``"text":address`` as links, other marks around them."""
    out, at = [], 0
    for m in _QUOTED_LINK.finditer(text):
        seen["outlink"] += 1
        out += [read(text[at : m.start()]), f"[{read(m[1])}]({m[2]})"]
        at = m.end()
    return "".join(out) + read(text[at:])


_LINES = {"mediawiki": _mediawiki, "creole": _creole, "textile": _textile}


def markdown_of(wiki: str, dialect: str) -> tuple[str, list[Counter]]:
    """A wiki text as Markdown, and the marks read in each of its lines."""
    inline, of_line = DIALECTS[dialect], _LINES[dialect]
    out, marks, verbatim = [], [], False
    for line in wiki.split("\n"):
        seen: Counter = Counter()
        if dialect == "creole" and line.strip() == ("}}}" if verbatim else "{{{"):
            verbatim = not verbatim
            seen["code"] += 1
            out.append("```")
        elif verbatim:
            out.append(line)
        else:
            out += of_line(line, lambda s, c=seen: inline.read(s, c), seen)
        marks.append(seen)
    return "\n".join(out), marks


def wiki_to_markdown(docs: DataFrame, dialect: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): texts of a wiki dialect as Markdown."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([markdown_of(t, dialect)[0] for t in batch.column(1).to_pylist()], pa.string())], [key, text])

    rows = docs.filter(F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(convert, rows.select(key).schema.add(text, "string"))


def wiki_rule_hits(docs: DataFrame, dialect: str, *, text: str = "text") -> DataFrame:
    """(``rule``, ``hits``): in how many lines each mark of a dialect is read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(name for t in batch.column(0).to_pylist() for seen in markdown_of(t, dialect)[1] for name in seen)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], ["rule", "n"])

    return docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(count, "rule string, n long").groupBy("rule").agg(F.sum("n").alias("hits"))
