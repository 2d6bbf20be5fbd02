"""Note vaults: front matter, tags, typed links and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import norm_relation

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
INLINE_TAG = r"(?:^|(?<=\s))#([\p{L}\w/-]*[\p{L}_/-][\p{L}\w/-]*)"
LINK = r"(?<!!)\[\[([^\]]+)\]\]"
TYPED = r"([A-Za-z][\w-]*)::[ \t]*\[\[([^\]]+)\]\]"


def body_of(text: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(text, FRONT, "")


def parse_frontmatter(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, ``name``, ``values``): ``name: value``, ``name: [a, b]``, or a list on the lines below."""
    block = F.regexp_extract(F.col(text), FRONT, 1)
    rows = notes.select(key, F.posexplode(F.split(block, r"\r?\n")).alias("n", "_l")).filter(F.trim("_l") != "")
    named = r"^([A-Za-z_][\w-]*):[ \t]*(.*)$"
    item = F.regexp_extract("_l", r"^[ \t]*-[ \t]+(.*)$", 1)
    rows = rows.withColumn("_k", F.when(F.col("_l").rlike(named), F.regexp_extract("_l", named, 1)))
    rows = rows.withColumn("name", F.last("_k", True).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).filter("name is not null")
    inline = F.regexp_extract("_l", named, 2)
    listed = F.split(F.regexp_replace(inline, r"^\[|\]$", ""), r"\s*,\s*")
    values = F.when(F.col("_k").isNull(), F.array(item)).when(inline.startswith("["), listed).otherwise(F.array(inline))
    bare = lambda v: F.regexp_replace(F.trim(v), r"^[\"']|[\"']$", "")
    rows = rows.select(key, "name", "n", F.filter(F.transform(values, bare), lambda v: v != "").alias("_v"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "_v"))), lambda x: x["_v"]))
    return rows.groupBy(key, "name").agg(ordered.alias("values"))


def vault_notes(notes: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Notes (key, ``text``) with ``title``, ``aliases``, ``tags``, ``body`` and ``links`` (``rel_type``, ``target``).

    Tags of the front matter come first, then those in the body; embedded
    files are no links; what follows ``#`` or a pipe in a link is dropped.
    """
    meta = parse_frontmatter(notes, key, text)
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("values")))
    front = meta.groupBy(key).agg(of("title").alias("_title"), of("aliases").alias("_aliases"), of("tags").alias("_tags"))
    none = F.array().cast("array<string>")
    body = body_of(F.col(text))
    stem = F.regexp_replace(F.element_at(F.split(F.col(key), "/"), -1), r"\.[^.]*$", "")
    target = lambda t: F.trim(F.regexp_replace(t, r"[#|].*$", ""))
    typed = F.zip_with(
        F.regexp_extract_all("body", F.lit(TYPED), F.lit(1)), F.regexp_extract_all("body", F.lit(TYPED), F.lit(2)),
        lambda r, t: F.struct(norm_relation(r).alias("rel_type"), target(t).alias("target")),
    )
    plain = F.transform(F.regexp_extract_all(F.regexp_replace("body", TYPED, ""), F.lit(LINK), F.lit(1)), lambda t: F.struct(F.lit(None).cast("string").alias("rel_type"), target(t).alias("target")))
    rows = notes.join(front, key, "left").withColumn("body", body)
    return rows.select(
        *notes.columns, "body",
        F.coalesce(F.get("_title", 0), stem).alias("title"), F.coalesce("_aliases", none).alias("aliases"),
        F.array_distinct(F.concat(F.transform(F.coalesce("_tags", none), lambda t: F.regexp_replace(t, "^#", "")), F.regexp_extract_all("body", F.lit(INLINE_TAG), F.lit(1)))).alias("tags"),
        F.concat(typed, plain).alias("links"),
    )


def resolve_links(vault: DataFrame, key: str = "path", default: str = "SEE_ALSO") -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved links): targets by file name, title, then alias; of equal names the first path wins.

    Equal (type, target) links of a note are one edge; every unresolved link counts.
    """
    stem = F.regexp_replace(F.element_at(F.split(F.col(key), "/"), -1), r"\.[^.]*$", "")
    names = vault.select(key, F.posexplode(F.concat(F.array(stem), F.array("title"), "aliases")).alias("_rank", "_name")).withColumn("_name", F.lower(F.trim("_name")))
    first = Window.partitionBy("_name").orderBy(F.least("_rank", F.lit(2)), key)
    index = names.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("_name", F.col(key).alias("dst"))
    links = vault.select(F.col(key).alias("src"), F.explode("links").alias("l")).select("src", F.coalesce("l.rel_type", F.lit(default)).alias("rel_type"), F.col("l.target").alias("target"), F.lower(F.trim("l.target")).alias("_name"))
    found = links.join(index, "_name", "left")
    return found.filter("dst is not null").select("src", "dst", "rel_type").distinct(), found.filter("dst is null").select("src", "rel_type", "target")


def vault_report(vault: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: notes, relations, unresolved links."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    rows = count(vault, "notes").unionByName(count(edges, "relations")).unionByName(count(unresolved, "unresolved"))
    return rows.groupBy().pivot("what", ["notes", "relations", "unresolved"]).agg(F.first("n"))


def tag_index(notes: DataFrame, tags: str = "tags") -> DataFrame:
    """(``tag``, ``notes``): how many notes carry each tag."""
    return notes.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))
