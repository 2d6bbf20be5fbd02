"""Search over content, metadata and notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import all_terms, count_of, norm_doi, norm_isbn, snippet


def search_content(docs: DataFrame, query: str, *, key: str = "doc_id", title: str = "title", text: str = "text", limit: int | None = 200, context: int = 60) -> DataFrame:
    """Documents whose text holds the query: hits, first snippet, most hits first.

    One pass over the text column; the top rows are kept per task and merged.
    """
    needle = query.strip().lower()
    if not needle:
        return docs.select(key, F.col(title).alias("title"), F.lit(0).cast("long").alias("hits"), F.lit("").alias("snippet")).limit(0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    at = F.instr(low, needle)
    found = docs.filter(F.contains(low, F.lit(needle))).select(key, F.col(title).alias("title"), count_of(low, needle).alias("hits"), snippet(F.col(text), at, len(needle), context).alias("snippet"))
    ordered = found.orderBy(F.desc("hits"), F.lower("title"), key)
    return ordered if limit is None else ordered.limit(limit)


def content_hits(docs: DataFrame, query: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the documents whose text holds the query."""
    needle = query.strip().lower()
    return docs.filter(F.contains(F.lower(text), F.lit(needle)) if needle else F.lit(False)).select(key)


def note_matches(query: str, note: Column, anchor: Column, tags: Column) -> Column:
    """All terms match: ``#x`` in a tag, any other in note, anchor or a tag."""
    out = F.lit(True)
    for term in query.lower().split():
        in_tags = lambda t: F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(t)))
        if term.startswith("#") and len(term) > 1:
            out &= in_tags(term[1:])
        else:
            has = lambda c, t=term: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t))
            out &= has(note) | has(anchor) | in_tags(term)
    return out


def match_notes(notes: DataFrame, query: str) -> DataFrame:
    """Notes (``note``, ``anchor``, ``tags``) that match all terms of the query."""
    return notes.filter(note_matches(query, F.col("note"), F.col("anchor"), F.col("tags")))


def filter_listing(listing: DataFrame, query: str, columns: tuple[str, ...] = ("title", "path", "source")) -> DataFrame:
    """Rows that hold all terms in their columns taken together."""
    return listing.filter(all_terms(query, F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))


def search_library(
    library: DataFrame, notes: DataFrame, *, query: str = "", doi: str = "", isbn: str = "", author: str = "", content: DataFrame | None = None, key: str = "path"
) -> DataFrame:
    """Library rows that meet all given criteria.

    The query looks into title, path, author and the bodies of the document's
    notes; ``content`` (keys of documents with a body hit) satisfies it too.
    """
    out = library
    if query.strip():
        bodies = notes.groupBy(F.col("doc").alias("_doc")).agg(F.concat_ws(" ", F.collect_list("note")).alias("_notes"))
        hay = F.concat_ws(" ", "title", F.col(key).cast("string"), "author", "_notes")
        out = out.join(bodies, out[key] == F.col("_doc"), "left").withColumn("_hit", F.contains(F.lower(hay), F.lit(query.strip().lower())))
        if content is not None:
            body = content.select(F.col(content.columns[0]).alias("_body")).distinct()
            out = out.join(body, out[key] == F.col("_body"), "left").withColumn("_hit", F.col("_hit") | F.col("_body").isNotNull())
        out = out.filter("_hit").select(*library.columns)
    if doi:
        out = out.filter(norm_doi(F.col("doi")) == norm_doi(F.lit(doi)))
    if isbn:
        out = out.filter(norm_isbn(F.col("isbn")) == norm_isbn(F.lit(isbn)))
    if author:
        out = out.filter(F.contains(F.lower("author"), F.lit(author.lower())))
    return out


def find_all(docs: DataFrame, query: str, *, key: str = "doc_id", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """Every occurrence, overlapping ones too: (key, 0-based ``offset``)."""
    if not query:
        return docs.select(key, F.lit(0).alias("offset")).limit(0)
    hay, needle = (F.col(text), query) if case_sensitive else (F.lower(text), query.lower())
    #: gaps between the starts of a look-ahead match; their running lengths are the offsets
    gaps = F.split(hay, f"(?={re.escape(needle)})", -1)
    hit = docs.filter(F.contains(hay, F.lit(needle))).select(key, F.startswith(hay, F.lit(needle)).alias("at_start"), F.posexplode(gaps).alias("n", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return hit.select(key, F.coalesce(before, F.lit(0)).cast("int").alias("offset"), ((F.col("n") > 0) | F.col("at_start")).alias("hit")).filter("hit").drop("hit")


def find_regex(docs: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line with a match: (key, ``line``, ``matches``); an invalid pattern is searched as plain text."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_text"))
    return lines.withColumn("matches", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).filter(F.size("matches") > 0).select(key, "line", "matches")


def replace_all(docs: DataFrame, query: str, new: str, *, text: str = "text") -> DataFrame:
    """Texts with every occurrence of a literal replaced, and ``replaced`` counts."""
    if not query:
        return docs.withColumn("replaced", F.lit(0).cast("long"))
    return docs.withColumn("replaced", count_of(F.coalesce(F.col(text), F.lit("")), query)).withColumn(text, F.replace(text, F.lit(query), F.lit(new)))
