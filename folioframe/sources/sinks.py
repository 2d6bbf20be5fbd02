"""Sinks: conversions with a log, citations, notes, graphs, vaults, captions and cards.

The formatting functions give one row per artefact; ``write_text`` writes any
of them. Nothing is put together on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import fmt_timestamp, sanitize_name

#: Names of output formats and what they stand for.
OUTPUTS = {"md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "plain": "text", "html": "html", "htm": "html", "json": "json"}
EXTENSIONS = {"markdown": "md", "text": "txt", "html": "html", "json": "json"}


def resolve_format(name: str) -> str:
    """The output format of a name; an unknown one raises."""
    try:
        return OUTPUTS[name.strip().lower().lstrip(".")]
    except KeyError:
        raise ValueError(f"unknown output format {name!r}") from None


def write_text(rows: DataFrame, path: str, column: str, by: str | None = None) -> None:
    """One text column written out, in folders by another column."""
    if by is None:
        rows.select(column).write.mode("errorifexists").text(path)
    else:
        rows.select(column, by).write.mode("errorifexists").partitionBy(by).text(path)


def unique_names(rows: DataFrame, name: str = "name", order: str = "source", style: str = " ({n})", taken: DataFrame | None = None) -> DataFrame:
    """Rows with ``unique``: equal names (whatever their case) numbered from 2, not meeting names that exist.

    A numbered name that some row already bears as its own moves on to the
    next free number.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order)))
    if taken is not None:
        there = taken.select(F.lower("name").alias("_there")).distinct()
        numbered = numbered.join(there, F.lower(name) == F.col("_there"), "left").withColumn("_n", F.col("_n") + F.col("_there").isNotNull().cast("int")).drop("_there")
    own = rows.select(F.lower(name).alias("_own")).distinct()
    label = lambda n: F.when(n <= 1, F.col(name)).otherwise(F.concat(stem, F.format_string(style.replace("{n}", "%d"), n), ext))
    first = numbered.withColumn("_try", label(F.col("_n")))
    meets = first.join(own, (F.lower("_try") == F.col("_own")) & (F.col("_n") > 1), "left")
    shift = F.sum(F.col("_own").isNotNull().cast("int")).over(Window.partitionBy(F.lower(name)).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return meets.withColumn("_n", F.col("_n") + F.when(F.col("_n") > 1, shift).otherwise(0)).withColumn("unique", label(F.col("_n"))).drop("_n", "_try", "_own")


def convert_corpus(files: DataFrame, fmt: str, render: Callable[[Column], Column] | None = None, *, key: str = "path", text: str = "text") -> DataFrame:
    """(``source``, ``output``, ``ok``, ``error``, ``content``) of every file.

    A bad format raises at once; a bad file becomes a row. Sources repeat
    once and are named in case-insensitive order; outputs never collide.
    """
    kind = resolve_format(fmt)
    ext = EXTENSIONS[kind]
    rows = files.dropDuplicates([key]).withColumn("_lower", F.lower(key))
    name = F.concat(F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.[^.]*$", ""), F.lit(f".{ext}"))
    named = unique_names(rows.withColumn("_name", name), "_name", "_lower")
    body = F.col(text) if render is None else render(F.col(text))
    good = F.col(text).isNotNull()
    out = {"html": F.concat(F.lit("<pre>"), F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</pre>")), "json": F.to_json(F.struct(F.col(key).alias("source"), body.alias("text")))}.get(kind, body)
    return named.select(F.col(key).alias("source"), F.when(good, F.col("unique")).alias("output"), good.alias("ok"), F.when(~good, F.lit("no readable text")).alias("error"), F.when(good, out).alias("content"))


def conversion_summary(results: DataFrame) -> DataFrame:
    """One row: total, ok, failed."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def conversion_log(results: DataFrame) -> DataFrame:
    """One line per file."""
    return results.select("source", F.when(F.col("ok"), F.concat(F.lit("ok      "), "source", F.lit(" -> "), "output")).otherwise(F.concat(F.lit("failed  "), "source", F.lit(": "), "error")).alias("line"))


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def write_citations(items: DataFrame, ext: str) -> DataFrame:
    """(``id``, ``record``): BibTeX, RIS or CSL-JSON; blank fields are left out."""
    if ext == "bib":
        fields = [F.when(_filled(c), F.concat(F.lit(f"  {c} = {{"), F.col(c).cast("string"), F.lit("}"))) for c in ("title", "author", "year", "journal", "doi", "url", "publisher")]
        text = F.concat(F.lit("@"), F.coalesce("type", F.lit("misc")), F.lit("{"), "id", F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}"))
    elif ext == "ris":
        tags = (("ID", "id"), ("TI", "title"), ("PY", "year"), ("JO", "journal"), ("DO", "doi"), ("UR", "url"), ("PB", "publisher"))
        authors = F.when(_filled("author"), F.concat(F.lit("AU  - "), F.replace(F.col("author"), F.lit(" and "), F.lit("\nAU  - "))))
        text = F.concat_ws("\n", F.concat(F.lit("TY  - "), F.upper(F.coalesce("type", F.lit("GEN")))), authors, *[F.when(_filled(c), F.concat(F.lit(f"{t}  - "), F.col(c).cast("string"))) for t, c in tags], F.lit("ER  - "))
    elif ext == "json":
        person = lambda a: F.struct(F.trim(F.element_at(F.split(a, ","), 1)).alias("family"), F.trim(F.get(F.split(a, ","), 1)).alias("given"))
        value = lambda c, name: F.when(_filled(c), F.col(c)).alias(name)
        issued = F.when(_filled("year"), F.struct(F.array(F.array("year")).alias("date-parts"))).alias("issued")
        text = F.to_json(F.struct("id", "type", value("title", "title"), F.when(_filled("author"), F.transform(F.split("author", " and "), person)).alias("author"), issued, value("journal", "container-title"), value("doi", "DOI"), value("url", "URL"), value("publisher", "publisher")))
    else:
        raise ValueError(f"unknown citation format {ext!r}")
    return items.select("id", text.alias("record"))


def notes_reference(notes: DataFrame, ext: str, meta: DataFrame | None = None, year: str | None = None) -> DataFrame:
    """(``doc``, ``artefact``): one reference per document that carries its notes, as bib or ris.

    ``meta`` has ``doc``, ``title``, ``author`` and ``source``; without it the
    document's key is its title. ``year`` is the year of export, this one if None.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    both = F.struct(F.row_number().over(Window.partitionBy("doc").orderBy("char_pos", "id")).alias("n"), blank("anchor").alias("a"), blank("note").alias("b"))
    listed = notes.withColumn("_x", both).groupBy("doc").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    known = listed.join(meta.select("doc", "title", "author", "source"), "doc", "left") if meta is not None else listed.withColumns({c: F.lit(None).cast("string") for c in ("title", "author", "source")})
    title, when = F.coalesce("title", F.col("doc").cast("string")), F.lit(year) if year else F.year(F.current_date()).cast("string")
    if ext == "bib":
        stem = F.regexp_replace(F.element_at(F.split(F.coalesce("source", F.lit("")), "/"), -1), r"\.[^.]*$", "")
        key = F.substring(F.regexp_replace(F.coalesce(F.nullif(stem, F.lit("")), title), r"(?U)\W+", ""), 1, 40)
        said = F.array_join(F.transform("_x", lambda x: F.trim(F.concat(F.lit("["), x["a"], F.lit("] "), x["b"]))), "; ")
        field = lambda name, c: F.when(blank(c) != "", F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
        fields = F.concat_ws(",\n", field("title", title), field("author", F.col("author")), field("howpublished", F.col("source")), field("year", when), F.concat(F.lit("  annote = {"), said, F.lit("}")))
        return known.select("doc", F.concat(F.lit("@misc{"), F.when(key == "", "notes").otherwise(key), F.lit(",\n"), fields, F.lit("\n}\n")).alias("artefact"))
    line = lambda tag, c: F.when(blank(c) != "", F.concat(F.lit(f"{tag}  - "), c))
    said = F.transform("_x", lambda x: F.concat(F.lit("N1  - "), F.when(x["a"] != "", F.concat(F.lit("“"), x["a"], F.lit("” — "))).otherwise(F.lit("")), x["b"]))
    lines = F.concat_ws("\r\n", F.lit("TY  - GEN"), line("TI", title), line("AU", F.col("author")), said, line("UR", F.col("source")), line("PY", when), F.lit("ER  - "), F.lit(""))
    return known.select("doc", lines.alias("artefact"))


def write_notes(notes: DataFrame, ext: str = "md", *, meta: DataFrame | None = None, year: str | None = None) -> DataFrame:
    """(``doc``, ``artefact``): each document's notes in order, as md, txt, json, bib or ris."""
    if ext in ("bib", "ris"):
        return notes_reference(notes, ext, meta, year)
    at = F.row_number().over(Window.partitionBy("doc").orderBy("char_pos", "id"))
    rows = notes.withColumn("_n", at)
    if ext == "json":
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct("id", "char_pos", "anchor", "note").alias("x")))), lambda x: x["x"])
        return rows.groupBy("doc").agg(F.to_json(ordered).alias("artefact"))
    if ext not in ("md", "txt"):
        raise ValueError(f"unknown note format {ext!r}")
    quote = F.when(_filled("anchor"), F.concat(F.lit("> " if ext == "md" else '"'), "anchor", F.lit("" if ext == "md" else '"')))
    line = F.concat("_n", F.lit(". "), F.concat_ws("\n" if ext == "md" else " - ", quote, F.when(_filled("note"), F.col("note"))))
    ordered = F.array_sort(F.collect_list(F.struct("_n", line.alias("l"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n\n").alias("artefact"))


def node_label() -> Column:
    """Anchor, else note, else id, on one line of at most 40 characters."""
    raw = F.coalesce(F.nullif(F.trim("anchor"), F.lit("")), F.nullif(F.trim("note"), F.lit("")), F.col("id").cast("string"))
    return F.substring(F.regexp_replace(raw, r"\n", " "), 1, 40)


def write_graph(nodes: DataFrame, edges: DataFrame, ext: str) -> DataFrame:
    """(``part``, ``line``): JSON rows with all edges; DOT and PlantUML only edges to known nodes."""
    known = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    label = F.replace(node_label(), F.lit('"'), F.lit("'"))
    if ext == "json":
        n, e = F.to_json(F.struct("id", node_label().alias("label"))), F.to_json(F.struct("src", "dst", "rel_type"))
        known = edges
    elif ext == "dot":
        n, e = F.concat(F.lit('  "'), "id", F.lit('" [label="'), label, F.lit('"];')), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "rel_type", F.lit('"];'))
    elif ext == "puml":
        n, e = F.concat(F.lit('object "'), label, F.lit('" as n'), "id"), F.concat(F.lit("n"), "src", F.lit(" --> n"), "dst", F.lit(" : "), "rel_type")
    else:
        raise ValueError(f"unknown graph format {ext!r}")
    return nodes.select(F.lit("node").alias("part"), n.alias("line")).unionByName(known.select(F.lit("edge").alias("part"), e.alias("line")))


def write_vault(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``id``, ``name``, ``content``): one note file each, typed links to exported notes only."""
    base = notes.withColumn("_base", sanitize_name(F.substring(node_label(), 1, 40)))
    named = unique_names(base, "_base", "id", " {n}").withColumnRenamed("unique", "name")
    target = named.select(F.col("id").alias("dst"), F.col("name").alias("_target"))
    links = edges.join(target, "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.concat("rel_type", F.lit(":: [["), "_target", F.lit("]]")))).alias("_links"))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]\n"))).otherwise(F.lit(""))
    body = F.concat(F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\n"), tags, F.lit("---\n\n"), F.concat_ws("\n\n", F.when(_filled("anchor"), F.concat(F.lit("> "), "anchor")), F.when(_filled("note"), F.col("note")), F.array_join("_links", "\n")))
    return named.join(links, "id", "left").select("id", "name", body.alias("content"))


def write_captions(cues: DataFrame, ext: str = "srt", key: str = "doc_id") -> DataFrame:
    """(key, ``n``, ``block``) in order; a cue without length lasts 0.05 s."""
    vtt = ext == "vtt"
    end = F.when(F.col("end_s") <= F.col("start_s"), F.col("start_s") + 0.05).otherwise(F.col("end_s"))
    times = F.concat(fmt_timestamp(F.col("start_s"), vtt), F.lit(" --> "), fmt_timestamp(end, vtt))
    head = F.when(F.col("n") == 0, F.lit("WEBVTT\n\n")).otherwise(F.lit("")) if vtt else F.concat((F.col("n") + 1).cast("string"), F.lit("\n"))
    return cues.select(key, "n", F.concat(head, times, F.lit("\n"), "cue", F.lit("\n")).alias("block")).sort(key, "n")


def deck_id(title: Column) -> Column:
    """A number from a deck's title."""
    return F.conv(F.substring(F.md5(title.cast("binary")), 1, 8), 16, 10).cast("long")


def write_cards(notes: DataFrame, cloze: DataFrame | None = None, title: str = "deck") -> DataFrame:
    """(``deck``, ``kind``, ``front``, ``back``): a basic card per note with content, and cloze cards if given."""
    basic = notes.filter(_filled("anchor") | _filled("note")).select(F.lit("basic").alias("kind"), F.coalesce("anchor", F.lit("")).alias("front"), F.coalesce("note", F.lit("")).alias("back"))
    out = basic if cloze is None else basic.unionByName(cloze.select(F.lit("cloze").alias("kind"), "front", "back"))
    return out.select(deck_id(F.lit(title)).alias("deck"), "kind", "front", "back")
