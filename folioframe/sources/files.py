"""Sources: file catalogs, text, delimited files, notebooks, archives, feeds, pages and bibliographies.

Every reader takes a path that Spark can open and gives a DataFrame; columns
that a query does not use (the bytes of a catalog's files, say) are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.sources import archives

#: Formats by file extension; a rule of the library, extended by ``register_reader``.
FORMATS = {
    "txt": "text", "text": "text", "log": "text", "md": "markdown", "markdown": "markdown", "rmd": "rmarkdown", "rst": "rst", "org": "org", "adoc": "asciidoc", "tex": "latex", "wiki": "mediawiki", "creole": "creole", "textile": "textile",
    "html": "html", "htm": "html", "xhtml": "html", "xml": "xml", "json": "json", "csv": "csv", "tsv": "tsv", "ipynb": "notebook", "pdf": "pdf", "epub": "epub", "docx": "docx", "odt": "odt", "rtf": "rtf", "pptx": "pptx", "xlsx": "xlsx",
    "py": "code", "js": "code", "java": "code", "c": "code", "cpp": "code", "rs": "code", "go": "code", "sh": "code", "sql": "code", "r": "code", "srt": "subtitles", "vtt": "subtitles", "bib": "bibtex", "ris": "ris", "zip": "archive", "tar": "archive",
}
JUNK = ("node_modules", "__pycache__", "__MACOSX", "venv", "build", "dist")
_READERS: dict[str, list[tuple[int, Callable[[SparkSession, str], DataFrame]]]] = {}


def file_format(path: Column) -> Column:
    """Format by extension, else ``text``; addresses are ``url``."""
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(path.rlike("^(?i:https?|ftp)://"), "url").otherwise(F.coalesce(F.try_element_at(table, ext), F.lit("text")))


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*FORMATS)


def scan_catalog(spark: SparkSession, folders: list[str], *, recursive: bool = True, max_files: int = 20_000) -> DataFrame:
    """Supported files of the folders: path, rel, title, format, size, mtime, folder.

    Hidden files and folders and junk folders are skipped; a folder lists
    ``max_files`` at most; of overlapping folders the first keeps a file.
    """
    out: DataFrame | None = None
    junk = "|".join(map(re.escape, JUNK))
    for n, folder in enumerate(folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        root = re.sub(r"^file:/*", "/", folder).rstrip("/")
        rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root) + "/", "")
        files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), rel.alias("rel"), "size", "mtime", F.lit(root).alias("folder"), F.lit(n).alias("folder_order"))
        files = files.filter(supported(F.col("rel")) & ~F.col("rel").rlike(r"(^|/)\.") & ~F.col("rel").rlike(rf"(^|/)(?:{junk})/"))
        files = files.orderBy(F.lower("rel")).limit(max_files)  # the first of each task, then of all
        out = files if out is None else out.unionByName(files)
    first = out.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("folder_order"))).filter("_n = 1")
    title = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.[^.]*$", "")
    return first.select("path", "rel", title.alias("title"), file_format(F.col("path")).alias("format"), "size", "mtime", "folder").orderBy(F.lower("folder"), F.lower("rel"))


def register_reader(ext: str, reader: Callable[[SparkSession, str], DataFrame], priority: int = 100) -> None:
    """A reader for an extension; of several the lowest number is taken."""
    _READERS.setdefault(ext.lower().lstrip("."), []).append((priority, reader))


def read_registered(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The union of what the registered readers make of ``extension -> path``."""
    out: DataFrame | None = None
    for ext, path in sorted(paths.items()):
        if not _READERS.get(ext):
            raise ValueError(f"no reader for {ext}")
        frame = min(_READERS[ext], key=lambda r: r[0])[1](spark, path)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_catalog(spark: SparkSession, folder: str, *, only: str = "*") -> DataFrame:
    """The files of a folder as one frame (``path``, ``format``, ``title``, ``text``), each by the reader of its extension.

    ``only`` is a pattern for names without extension; it and the extension go
    into the path that a reader gets, so other files are never opened. Readers
    are those of ``BUILT_IN`` and registered ones; the lowest number counts, and
    where numbers are equal the registered one. What a reader doesn't say is filled in.
    """
    of = {e: min(_READERS.get(e, []) + [(200, r) for r in [BUILT_IN.get(e)] if r], key=lambda r: r[0])[1] for e in sorted({*_READERS, *BUILT_IN})}
    context, out = spark.sparkContext, None
    for ext, reader in of.items():
        pattern = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{only}.{ext}")
        if not pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern):
            continue
        rows = reader(spark, pattern.toString())
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        title = F.coalesce("title", name) if "title" in rows.columns else name
        frame = rows.select("path", file_format(F.col("path")).alias("format"), title.alias("title"), "text")
        out = frame if out is None else out.unionByName(frame)
    return spark.createDataFrame([], "path string, format string, title string, text string") if out is None else out


def notebook_markdown(cells: DataFrame) -> DataFrame:
    """(``path``, ``text``) of notebook cells; code is fenced, an unreadable notebook has a null text."""
    shown = F.when(F.col("kind") == "code", F.concat(F.lit("```"), "language", F.lit("\n"), "source", F.lit("\n```"))).when(F.col("kind") == "markdown", F.col("source"))
    ordered = F.array_sort(F.collect_list(F.struct("n", shown.alias("t"))))
    text = F.when(F.max("kind") != "error", F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n"))
    return cells.groupBy("path").agg(text.alias("text"))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (``path``, ``title``, ``text``): the first heading, else the file's name; front matter off."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.withColumn("text", F.regexp_replace("text", r"(?s)^---\r?\n.*?\r?\n---\r?\n", ""))
    heading = F.trim(F.regexp_extract("text", r"(?m)^# (.+)$", 1))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select("path", F.when(heading != "", heading).otherwise(name).alias("title"), "text")


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(``path``, ``row``, ``cells``): rows padded to the widest of their file; row 0 is the header.

    Fields may be quoted. The rows of one file are numbered by their place: inside
    each split, and from there by the counts of the splits before, so that a large
    file isn't one task's work.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    quoted = rf'(?:^|{re.escape(sep)})(?:"((?:[^"]++|"")*+)"|([^{re.escape(sep)}]*))'
    pieces = F.regexp_extract_all("value", F.lit(quoted), F.lit(0))
    clean = F.transform(pieces, lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^" + re.escape(sep), ""), r'^"|"$', ""), '""', '"'))
    rows = lines.withColumn("cells", clean)
    whole = Window.partitionBy("path")
    ahead = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("cells")).alias("_m"))
    #: one row per split
    splits = splits.select("path", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.max("_m").over(whole).alias("_w"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("path", "_b").orderBy("_i")) - 1).join(splits, ["path", "_b"])
    return numbered.select("path", (F.col("_before") + F.col("_k")).cast("int").alias("row"), F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells"))).alias("cells"))


def delimited_markdown(rows: DataFrame) -> DataFrame:
    """(``path``, ``markdown``) of delimited rows; pipes in cells are escaped."""
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("cells", lambda c: F.lit("---")), "|"), F.lit("|"))
    text = F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line)
    ordered = F.array_sort(F.collect_list(F.struct("row", text.alias("t"))))
    return rows.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("markdown"))


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``n``, ``kind``, ``language``, ``source``) of notebooks; an unreadable one is an ``error`` row."""
    schema = "cells array<struct<cell_type:string,source:string>>, metadata struct<kernelspec:struct<language:string>>"
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("j"))
    # the cells alone go into the generator, or each cell's row would hold the whole notebook
    good = rows.filter("j.cells is not null").select("path", F.coalesce("j.metadata.kernelspec.language", F.lit("python")).alias("language"), F.col("j.cells").alias("_cells"))
    good = good.select("path", "language", F.posexplode("_cells").alias("n", "c"))
    source = F.coalesce(F.array_join(F.from_json("c.source", "array<string>"), ""), F.col("c.source"))
    cells = good.filter(F.col("c.cell_type").isin("markdown", "code")).select("path", "n", F.col("c.cell_type").alias("kind"), "language", source.alias("source"))
    bad = rows.filter("j is null or j.cells is null").select("path", F.lit(0).alias("n"), F.lit("error").alias("kind"), F.lit(None).cast("string").alias("language"), F.lit("no readable notebook").alias("source"))
    return cells.unionByName(bad)


#: Readers that need no registration: (path, text) and perhaps a title, by extension.
BUILT_IN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **dict.fromkeys(("txt", "text", "md", "markdown", "log"), read_text_corpus),
    "csv": lambda spark, path: delimited_markdown(read_delimited(spark, path)).withColumnRenamed("markdown", "text"),
    "tsv": lambda spark, path: delimited_markdown(read_delimited(spark, path, "\t")).withColumnRenamed("markdown", "text"),
    "ipynb": lambda spark, path: notebook_markdown(notebook_cells(spark, path)),
}


def archive_members(spark: SparkSession, path: str, *, content: bool = False, range_bytes: int = archives.RANGE_BYTES) -> DataFrame:
    """Members of zip and tar archives: (``path``, ``member``, ``ref``, ``offset``, ``size``, ``content``, ``error``).

    Folders, hidden members, resource forks and unsupported formats are left
    out; an unreadable archive has none. Members are read in ranges of
    ``range_bytes`` of their archive, and only if ``content`` is asked for; a
    task takes several ranges where there are more than eight a core.
    """
    archives.register(spark)
    tasks = 8 * spark.sparkContext.defaultParallelism
    found = spark.read.format("folio_archives").options(content=str(content).lower(), range_bytes=str(range_bytes), tasks=str(tasks)).load(path)
    return found.filter(supported(F.col("member")) & ~F.col("member").rlike(r"(^|/)(?:\.|__MACOSX/)"))


def new_members(members: DataFrame, library: DataFrame) -> DataFrame:
    """Members whose reference the library (``path``) does not have."""
    return members.join(library.select(F.col("path").alias("ref")), "ref", "left_anti")


def feed_items(spark: SparkSession, path: str, *, most: int = 50) -> DataFrame:
    """(``feed``, ``n``, ``title``, ``url``, ``summary``, ``published``): the first entries, then those with a link."""
    item = "array<struct<title:string,link:string,description:string,pubDate:string>>"
    rows = spark.read.format("xml").option("rowTag", "channel").schema(f"title string, item {item}").load(path)
    entries = rows.select(F.col("title").alias("feed"), F.posexplode(F.slice("item", 1, most)).alias("n", "i")).filter("trim(i.link) <> ''")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return entries.select("feed", "n", F.coalesce(F.nullif(F.trim("i.title"), F.lit("")), F.col("i.link")).alias("title"), F.col("i.link").alias("url"), blank("i.description").alias("summary"), blank("i.pubDate").alias("published"))


# ---- pages


BOILERPLATE = frozenset("script style noscript template nav footer aside form iframe svg button select textarea head".split())
BLOCK = "page_id long, seq int, kind string, level int, text string, href string"
#: Rows of blocks that go out of Python at once.
BLOCK_ROWS = 10_000


_OPEN, _CLOSE = re.compile(r"<([A-Za-z][^\s/>]*+)"), re.compile(r"</([A-Za-z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
_TAG_END = re.compile(r"[\s/=]*+>")
#: Elements whose content is no markup.
RAW = frozenset("script style".split())


def markup_events(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(``open``, tag, attributes), (``close``, tag, None) and (``text``, text, None) of a page in one pass.

    Comments and declarations are passed over. What never ends (a comment, a tag
    or a quote at the end of the page) is looked for once: an unfinished comment
    takes the rest, the rest behind an unfinished tag is text.
    """
    at, text_from, end = 0, 0, len(html)
    say = lambda upto: [("text", unescape(html[text_from:upto]), None)] if upto > text_from else []
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            after = html.find("-->", at + 4)
            after = end if after < 0 else after + 3
            yield from say(at)
        elif html.startswith(("<!", "<?"), at):
            after = html.find(">", at)
            if after < 0:
                break
            after += 1
            yield from say(at)
        elif m := _CLOSE.match(html, at):
            after = m.end()
            yield from say(at)
            yield "close", m[1].lower(), None
        elif m := _OPEN.match(html, at):
            tag, named, after = m[1].lower(), {}, m.end()
            while a := _ATTRIBUTE.match(html, after):
                value = a[2] or ""
                named.setdefault(a[1].lower(), unescape(value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0] else value))
                after = a.end()
            closed = _TAG_END.match(html, after)
            if not closed:
                break
            after = closed.end()
            yield from say(at)
            yield "open", tag, named
            if tag in RAW and not html[closed.start() : after].endswith("/>"):
                stop = re.compile(f"</{tag}(?![^\\s/>])", re.I).search(html, after)
                text_from, after = after, stop.start() if stop else end
                yield from say(after)
        elif html.startswith("</", at) and html.find(">", at) < 0:
            break
        else:
            at += 1
            continue
        at = text_from = after
    yield from say(end)


class _Blocks:
    """Rows of a page: titles, headings, paragraphs, items, tables, links, images.

    Emphasis is marked in the text. An item of an ordered list has its number in
    the last column; a table is one row in pipe form.
    """

    KINDS = {**{f"h{n}": ("heading", n) for n in range(1, 7)}, "p": ("paragraph", 0), "li": ("item", 0), "blockquote": ("quote", 0), "pre": ("code", 0), "figcaption": ("caption", 0), "title": ("title", 0)}
    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
    CUTS = frozenset("div ul ol table tr td th section article main header figure".split())

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str, str | None]] = []
        self.parts: list[str] = []
        self.kind: tuple[str, int, str | None] = ("paragraph", 0, None)
        self.silent = 0
        self.link: tuple[str, list[str]] | None = None
        self.lists: list[list] = []  #: [ordered, items so far] of each open list
        self.marks: dict[str, int] = {}  #: open marks and how often, by the first to open
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text and self.cell is not None:
            self.cell.append(text)
        elif text:
            self.rows.append((self.kind[0], self.kind[1], text, self.kind[2]))
        self.parts, self.kind = [], ("paragraph", 0, None)

    def end_cell(self) -> None:
        self.flush()
        if self.cell is not None and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(" ".join(self.cell).replace("|", "\\|"))
        self.cell = None

    def end_table(self) -> None:
        self.end_cell()
        rows = [r for r in self.tables.pop() if any(r)] if self.tables else []
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.rows.append(("table", 0, "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]), None))

    def read(self, html: str) -> list[tuple[str, int, str, str | None]]:
        """The page's rows."""
        for what, value, named in markup_events(html):
            if what == "open":
                self.begin(value, named)
            elif what == "close":
                self.end(value)
            else:
                self.say(value)
        while self.tables:
            self.end_table()
        self.flush()
        return self.rows

    def begin(self, tag: str, named: dict[str, str]) -> None:
        if tag in BOILERPLATE and tag != "head":
            self.silent += 1
        if tag in self.KINDS or tag in self.CUTS:
            self.flush()
        if tag in self.KINDS:
            self.kind = (*self.KINDS[tag], None)
        if tag in ("ul", "ol"):
            self.lists.append([tag == "ol", 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.kind = ("item", len(self.lists), f"{self.lists[-1][1]}." if self.lists[-1][0] else None)
        elif tag == "table":
            self.tables.append([])
            self.cell = None
        elif tag in ("tr", "td", "th") and self.tables:
            self.end_cell()
            if tag == "tr":
                self.tables[-1].append([])
            else:
                self.cell = []
        if tag in self.MARKS:
            self.marks[tag] = self.marks.get(tag, 0) + 1
        if tag == "a" and named.get("href"):
            self.link = (named["href"], [])
        if tag == "img" and not self.silent:
            text = next((named[k] for k in ("alt", "aria-label", "title", "longdesc") if named.get(k)), "")
            self.rows.append(("image", 0, text, named.get("src")))

    def end(self, tag: str) -> None:
        if tag in BOILERPLATE and tag != "head":
            self.silent = max(0, self.silent - 1)
        if tag in self.KINDS:
            self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.flush()
            self.lists.pop()
        if tag in ("td", "th", "tr"):
            self.end_cell()
        if tag == "table":
            self.end_table()
        if tag in self.marks:
            self.marks[tag] -= 1
            if not self.marks[tag]:
                del self.marks[tag]
        if tag == "a" and self.link:
            self.rows.append(("link", 0, re.sub(r"\s+", " ", "".join(self.link[1])).strip(), self.link[0]))
            self.link = None

    def say(self, data: str) -> None:
        if self.link:
            self.link[1].append(data)
        if self.silent:
            return
        core = data.strip()
        if self.marks and core:
            kinds = [self.MARKS[t] for t in self.marks]
            mark = "`" if "`" in kinds else "".join(dict.fromkeys(kinds))
            at = data.index(core)
            data = f"{data[:at]}{mark}{core}{mark[::-1]}{data[at + len(core) :]}"
        self.parts.append(data)


def page_blocks(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(``page_id``, ``seq``, ``kind``, ``level``, ``text``, ``href``): every page parsed once."""

    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "seq", "kind", "level", "text", "href"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks go out as soon as there are enough; a batch of pages may have millions."""
        for batch in batches:
            out: list[tuple] = []
            for k, value in zip(batch.column(0), batch.column(1), strict=True):
                page = k.as_py()
                out += [(page, n, *row) for n, row in enumerate(_Blocks().read(value.as_py() or ""))]
                if len(out) >= BLOCK_ROWS:
                    yield from (rows(out[i : i + BLOCK_ROWS]) for i in range(0, len(out), BLOCK_ROWS))
                    out = []
            if out:
                yield rows(out)

    return pages.select(F.col(key).cast("long"), html).mapInArrow(parse, BLOCK)


def extract_pages(blocks: DataFrame) -> DataFrame:
    """(``page_id``, ``markdown``): titles, headings, paragraphs, items, tables, quotes and images in order."""
    mark = (
        F.when(F.col("kind") == "title", F.concat(F.lit("# "), "text"))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text"))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.coalesce("href", F.lit("-")), F.lit(" "), "text"))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), "text"))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("kind") == "image", F.concat(F.lit("!["), "text", F.lit("]("), F.coalesce("href", F.lit("")), F.lit(")")))
        .otherwise(F.col("text"))
    )
    rows = blocks.filter("kind <> 'link'").withColumn("_m", mark)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "_m")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["_m"]), "\n\n").alias("markdown"))


def page_links(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(``page_id``, ``seq``, ``href``, ``text``, ``host``): out-links; relative ones take the page's host."""
    links = blocks.filter("kind = 'link'").select("page_id", "seq", "href", "text")
    host = lambda c: F.lower(F.regexp_extract(c, "^[a-z]+://([^/?#]+)", 1))
    if pages is None:
        return links.withColumn("host", host(F.col("href")))
    own = pages.select("page_id", host(F.col("url")).alias("_host"))
    return links.join(own, "page_id", "left").withColumn("host", F.when(host(F.col("href")) != "", host(F.col("href"))).otherwise(F.col("_host"))).drop("_host")


# ---- bibliographies


CITATION = ("id", "type", "title", "author", "year", "journal", "doi", "url", "publisher")
#: Fields of the tagged format.
RIS_FIELDS = {"TI": "title", "T1": "title", "PY": "year", "Y1": "year", "JO": "journal", "JF": "journal", "T2": "journal", "DO": "doi", "UR": "url", "PB": "publisher", "ID": "id"}


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CITATION))


def parse_ris(texts: DataFrame, text: str = "text") -> DataFrame:
    """Citations of tagged records: ``TY`` opens one, ``ER`` closes it."""
    numbered = texts.select(F.monotonically_increasing_id().alias("file"), text)
    lines = numbered.select("file", F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    tag, value = F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?(.*)$", 1), F.trim(F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?(.*)$", 2))
    rows = lines.select("file", "n", tag.alias("tag"), value.alias("value")).filter("tag <> ''")
    rows = rows.withColumn("rec", F.sum((F.col("tag") == "TY").cast("int")).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    field = F.create_map(*[F.lit(x) for kv in RIS_FIELDS.items() for x in kv])
    rows = rows.withColumn("field", F.try_element_at(field, F.col("tag")))
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("n"))).alias(f)
    authors = F.array_sort(F.collect_list(F.when(F.col("tag").isin("AU", "A1"), F.struct("n", "value"))))
    found = rows.groupBy("file", "rec").agg(
        F.max(F.when(F.col("tag") == "TY", F.lower("value"))).alias("type"), F.max((F.col("tag") == "ER").cast("int")).alias("_closed"), authors.alias("_authors"), *(last(f) for f in ("title", "year", "journal", "doi", "url", "publisher", "id"))
    ).filter("_closed = 1")
    names = F.transform("_authors", lambda a: a["value"])
    year = F.substring("year", 1, 4)
    made = F.regexp_replace(F.concat(F.trim(F.element_at(F.split(F.coalesce(F.get(names, 0), F.lit("ref")), ","), 1)), F.coalesce(year, F.lit(""))), r"\W+", "")
    key = F.coalesce(F.nullif("id", F.lit("")), F.nullif(made, F.lit("")), F.lit("ref"))
    return _columns(found.withColumn("author", F.nullif(F.array_join(names, " and "), F.lit(""))).withColumn("year", year).withColumn("id", key))


def parse_bibtex(texts: DataFrame, text: str = "text") -> DataFrame:
    """Citations of BibTeX entries; values may hold braces two deep; a book's title serves as journal."""
    entries = texts.select(F.explode(F.split(text, r"(?m)(?:^|\s)@(?=\w+\s*\{)")).alias("e")).filter(F.col("e").rlike(r"^\w+\s*\{"))
    pattern = r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\w+))"
    names = F.transform(F.regexp_extract_all("e", F.lit(pattern), F.lit(1)), lambda x: F.lower(x))
    values = F.zip_with(F.zip_with(F.regexp_extract_all("e", F.lit(pattern), F.lit(2)), F.regexp_extract_all("e", F.lit(pattern), F.lit(3)), lambda a, b: F.concat(a, b)), F.regexp_extract_all("e", F.lit(pattern), F.lit(4)), lambda a, b: F.concat(a, b))
    clean = F.transform(values, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, "[{}]", ""), r"\s+", " ")))
    rows = entries.select(F.lower(F.regexp_extract("e", r"^(\w+)", 1)).alias("type"), F.trim(F.regexp_extract("e", r"^\w+\s*\{\s*([^,]*),", 1)).alias("id"), names.alias("_n"), clean.alias("_v"))
    get = lambda f: F.get("_v", F.nullif(F.array_position("_n", f), F.lit(0)).cast("int") - 1)
    return _columns(rows.select("id", "type", *(get(f).alias(f) for f in ("title", "author", "year", "doi", "url", "publisher")), F.coalesce(get("journal"), get("booktitle")).alias("journal")))


def parse_csl(texts: DataFrame, text: str = "text") -> DataFrame:
    """Citations of CSL-JSON, one object or a list."""
    one = "struct<id:string,type:string,title:string,author:array<struct<family:string,given:string>>,issued:struct<`date-parts`:array<array<string>>>,`container-title`:string,DOI:string,URL:string,publisher:string>"
    c = texts.select(F.explode(F.from_json(F.when(F.trim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(F.col(text)), f"array<{one}>")).alias("c")).select("c.*")
    name = lambda a: F.when(F.coalesce(a["family"], F.lit("")) != "", F.concat_ws(", ", a["family"], F.nullif(a["given"], F.lit("")))).otherwise(a["given"])
    return c.select(
        "id", F.coalesce("type", F.lit("article")).alias("type"), "title", F.array_join(F.transform("author", name), " and ").alias("author"), F.get(F.get(F.col("issued.`date-parts`"), 0), 0).alias("year"),
        F.col("`container-title`").alias("journal"), F.col("DOI").alias("doi"), F.col("URL").alias("url"), "publisher",
    )


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Citations of files by what they hold: JSON, BibTeX, else tagged records."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", "text")
    start = F.substring(F.trim(F.regexp_replace("text", r"^\s+", "")), 1, 1)
    json, bib = start.isin("[", "{"), F.col("text").rlike(r"(?m)^\s*@\w+\s*\{")
    return parse_csl(rows.filter(json)).unionByName(parse_bibtex(rows.filter(~json & bib))).unionByName(parse_ris(rows.filter(~json & ~bib)))
