"""Queries on page parsing, sinks and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.operators import vault
from folioframe.plans import library_queries
from folioframe.plans import views as V
from folioframe.session import shared_folder, table
from folioframe.sources import files, sinks
from folioframe.streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""select page_id, len(regexp_extract_all(html, '<a href=')) as links, len(regexp_extract_all(html, '<h1>')) as headings from pages""")
def page_blocks(spark, sf):
    b = files.page_blocks(table(spark, sf, "pages"))
    n = lambda k: F.count_if(F.col("kind") == k)
    return b.groupBy("page_id").agg(n("link").alias("links"), n("heading").alias("headings"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as own from pages)
select case when regexp_extract(href, '^[a-z]+://([^/?#]+)', 1) <> '' then lower(regexp_extract(href, '^[a-z]+://([^/?#]+)', 1)) else own end as host, count(*) as links, count(distinct page_id) as pages from l group by all""")
def page_links(spark, sf):
    p = table(spark, sf, "pages")
    return files.page_links(files.page_blocks(p), p).groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


@query()
def extract_pages(spark, sf):
    return files.extract_pages(files.page_blocks(table(spark, sf, "pages")))


@query("""select concat('/in/', p_brand, '.doc') as source, concat(p_brand, '.txt') as output, p_brand <> 'Brand#11' as ok from (select distinct p_brand from part) p where p_brand <> 'Brand#11'
union all select '/in/Brand#11.doc', null, false from (select 1) x where exists (select 1 from part where p_brand = 'Brand#11')""")
def convert_corpus(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("/in/"), "p_brand", F.lit(".doc")).alias("path"), F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("text"))
    return sinks.convert_corpus(p, "txt").select("source", "output", "ok")


@query("""select p_partkey as source, p_brand || case when n > 1 then ' (' || n || ')' else '' end as "unique" from (select p_partkey, p_brand, row_number() over (partition by lower(p_brand) order by p_partkey) as n from part) x""")
def unique_names(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("name"))
    return sinks.unique_names(p).select("source", "unique")


@query("""select count(*) as total, cast(count_if(p_size > 10) as bigint) as ok, cast(count_if(p_size <= 10) as bigint) as failed from part""")
def conversion_summary(spark, sf):
    return sinks.conversion_summary(table(spark, sf, "part").select((F.col("p_size") > 10).alias("ok")))


@query("""select c_custkey as id, '@book{' || c_custkey || ',' || chr(10) || '  title = {' || c_name || '},' || chr(10) || '  year = {19' || lpad(cast(c_nationkey as varchar), 2, '0') || '}' || chr(10) || '}' as record from customer""")
def write_citations(spark, sf):
    none = F.lit(None).cast("string")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("book").alias("type"), F.col("c_name").alias("title"), F.lit(" ").alias("author"), F.concat(F.lit("19"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("year"), *(none.alias(x) for x in ("journal", "doi", "url", "publisher")))
    return sinks.write_citations(c, "bib")


@query(f"""with n as ({V.plain(V.NOTES)}), o as (select *, row_number() over (partition by doc order by char_pos, id) as k from n)
select doc, string_agg(k || '. ' || concat_ws(chr(10), case when trim(anchor) <> '' then '> ' || anchor end, case when trim(note) <> '' then note end), chr(10) || chr(10) order by k) as artefact from o group by doc""")
def write_notes(spark, sf):
    return sinks.write_notes(V.frame(spark, sf, V.NOTES))


@query(f"""with n as ({V.plain(V.NOTES)}), e as ({V.plain(V.EDGES)})
select 'edge' as part, '  "' || src || '" -> "' || dst || '" [label="' || rel_type || '"];' as line from e where dst in (select id from n)
union all select 'node', '  "' || id || '" [label="' || replace(substr(replace(coalesce(nullif(trim(anchor, ' '), ''), nullif(trim(note, ' '), ''), cast(id as varchar)), chr(10), ' '), 1, 40), '"', '''') || '"];' from n""")
def write_graph(spark, sf):
    return sinks.write_graph(V.frame(spark, sf, V.NOTES), V.frame(spark, sf, V.EDGES), "dot")


@query()
def write_vault(spark, sf):
    return sinks.write_vault(V.frame(spark, sf, V.NOTES).withColumn("tags", F.array("tag")), V.frame(spark, sf, V.EDGES))


@query("""select l_orderkey as doc_id, cast(l_linenumber - 1 as int) as n, l_linenumber || chr(10) || '00:00:' || lpad(cast(3 * l_linenumber as varchar), 2, '0') || ',500 --> 00:00:' ||
case when l_quantity > 25 then lpad(cast(3 * l_linenumber as varchar), 2, '0') || ',550' else lpad(cast(3 * l_linenumber + 1 as varchar), 2, '0') || ',250' end || chr(10) || l_returnflag || chr(10) as block from lineitem""")
def write_captions(spark, sf):
    """A caption file per order, a cue per line of it."""
    start = F.col("l_linenumber") * 3 + 0.5
    cues = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("n"), start.alias("start_s"), F.when(F.col("l_quantity") > 25, start).otherwise(start + 0.75).alias("end_s"), F.col("l_returnflag").alias("cue"))
    return sinks.write_captions(cues)


@query(f"""with n as ({V.plain(V.NOTES)}) select 'basic' as kind, anchor as front, note as back from n where trim(anchor) <> '' or trim(note) <> ''""")
def write_cards(spark, sf):
    return sinks.write_cards(V.frame(spark, sf, V.NOTES)).select("kind", "front", "back")


# ---- files that Spark writes from the tables, and reads back


def _written(frame, spark, column: str = "value", by: str | None = None, fmt: str = "text", **options) -> str:
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    writer = frame.write.options(**options)
    (writer.partitionBy(by) if by else writer).format(fmt).save(folder)
    return folder


def _brands(spark, sf):
    """Rows of up to a thousand parts of a brand, in order; their number grows with the table, not their size."""
    p = table(spark, sf, "part").withColumn("p_name", F.regexp_replace("p_name", "[^A-Za-z0-9 #]", " ")).withColumn("p_brand", F.concat("p_brand", F.lit("-"), F.floor(F.col("p_partkey") / 1000)))
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    return p.groupBy("p_brand").agg(ordered.alias("parts"))


@query("""select p_partkey as key, p_name || ', "x"|' as name, cast(p_size as varchar) as size, '' as extra from part""")
def read_delimited(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat("p_name", F.lit(', "x"|')).alias("name"), F.col("p_size").cast("string").alias("size"), F.lit(None).cast("string").alias("extra"))
    folder = _written(p.repartition(3), spark, fmt="csv", header="true", escape='"')
    cells = files.read_delimited(spark, f"{folder}/*.csv").filter("row > 0")
    return cells.select(F.get("cells", 0).cast("long").alias("key"), F.get("cells", 1).alias("name"), F.get("cells", 2).alias("size"), F.regexp_replace(F.get("cells", 3), '^""$', "").alias("extra"))


@query("""select md5(text) as digest, count(*) as n from documents group by md5(text)""")
def read_text_corpus(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("# Doc "), "doc_id", F.lit("\n"), "text").alias("value"), F.col("doc_id").alias("part"))
    # one line per record, so that one file holds several whole texts: at most 200, so that the files' number grows with the table, not their size
    folder = _written(d.select(F.base64(F.encode("value", "UTF-8")).alias("value")).withColumn("value", F.regexp_replace("value", r"\s", "")), spark, maxRecordsPerFile=200)
    lines = files.read_text_corpus(spark, folder).select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    body = F.regexp_replace(F.decode(F.unbase64("line"), "UTF-8"), r"^# Doc \d+\n", "")
    return lines.select(F.md5(body.cast("binary")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))


@query("""select p_brand, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as int) as n, case when p_size > 25 then 'code' else 'markdown' end as kind, p_partkey || '-line' as source from (select * replace (p_brand || '-' || (p_partkey // 1000) as p_brand) from part) b""")
def notebook_cells(spark, sf):
    cell = lambda p: F.struct(F.when(p["p_size"] > 25, "code").otherwise("markdown").alias("cell_type"), F.array(p["p_partkey"].cast("string"), F.lit("-line")).alias("source"))
    books = _brands(spark, sf).select("p_brand", F.to_json(F.struct(F.transform("parts", cell).alias("cells"), F.struct(F.struct(F.lit("sql").alias("language")).alias("kernelspec")).alias("metadata"))).alias("value"))
    folder = _written(books.repartition("p_brand"), spark, by="p_brand")
    brand = F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]+)/", 1)))  # once for the folder's name, once for its address
    return files.notebook_cells(spark, folder).select(brand.alias("p_brand"), "n", "kind", "source")


@query("""select feed, cast(n as int) as n, title, url from (select p_brand as feed, row_number() over (partition by p_brand order by p_partkey) - 1 as n, case when p_size % 2 = 0 then 'part ' || p_partkey else 'http://x.example/' || p_partkey end as title, 'http://x.example/' || p_partkey as url, p_size from (select * replace (p_brand || '-' || (p_partkey // 1000) as p_brand) from part) b) x where n < 50 and p_size % 5 <> 0""")
def feed_items(spark, sf):
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    url = lambda p: F.concat(F.lit("http://x.example/"), p["p_partkey"])
    item = lambda p: tag("item", F.concat(F.when(p["p_size"] % 2 == 0, tag("title", F.concat(F.lit("part "), p["p_partkey"]))).otherwise(F.lit("")), F.when(p["p_size"] % 5 != 0, tag("link", url(p))).otherwise(F.lit(""))))
    feeds = _brands(spark, sf).select(tag("rss", tag("channel", F.concat(tag("title", F.col("p_brand")), F.array_join(F.transform("parts", item), "")))).alias("value"), F.col("p_brand").alias("b"))
    # a file holds the feeds of 8,000 parts, so that whole files stay small and their number is not that of the feeds
    several = feeds.groupBy(F.floor(F.regexp_extract("b", r"-(\d+)$", 1).cast("long") / 8)).agg(F.concat(F.lit("<feeds>"), F.array_join(F.collect_list("value"), ""), F.lit("</feeds>")).alias("value"))
    return files.feed_items(spark, _written(several.select("value"), spark, maxRecordsPerFile=1)).select("feed", "n", "title", "url")


@query("""select 'c' || c_custkey as id, c_name as title, case when c_custkey % 3 = 0 then 'Doe, J and Roe, K' else 'Doe, J' end as author, '2019' as year from customer""")
def read_bibliography(spark, sf):
    c = table(spark, sf, "customer").repartition(4)
    author = F.when(F.col("c_custkey") % 3 == 0, "Doe, J and Roe, K").otherwise("Doe, J")
    cited = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("book").alias("type"), F.col("c_name").alias("title"), author.alias("author"), F.lit("2019").alias("year"), *(F.lit(None).cast("string").alias(x) for x in ("journal", "doi", "url", "publisher")))
    third = lambda n: cited.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == n)
    found = None
    for n, ext in enumerate(("bib", "ris", "json")):
        text = F.col("record") if ext != "json" else F.concat(F.col("record"), F.lit(","))
        rows = sinks.write_citations(third(n), ext).select(text.alias("value"))
        if ext == "json":  # a list per file
            rows = rows.withColumn("k", F.spark_partition_id()).groupBy("k").agg(F.concat(F.lit("["), F.regexp_replace(F.array_join(F.collect_list("value"), "\n"), ",$", ""), F.lit("]")).alias("value")).select("value").repartition(8, "value")
            folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
            rows.withColumn("k", F.monotonically_increasing_id()).write.partitionBy("k").text(folder)
        else:
            folder = _written(rows, spark)
        part = files.read_bibliography(spark, folder)
        found = part if found is None else found.unionByName(part)
    return found.select("id", "title", "author", "year")


def _vault(spark, sf):
    """The conversations as notes: front matter, a tag, a typed link to the turn before, one to a missing note."""
    c = table(spark, sf, "conversations")
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("t"), turn)
    text = F.concat(F.lit("---\ntitle: Turn "), "conv_id", F.lit(" "), "turn", F.lit("\ntags: ["), "role", F.lit(", note]\n---\nBody #inline\n"), F.when(F.col("turn") > 0, F.concat(F.lit("follows:: [["), name(F.col("turn") - 1), F.lit("|before]]\n"))).otherwise(F.lit("")), F.lit("![[embed]]\n"), F.when(F.col("turn") == 0, F.lit("[[nowhere]]")).otherwise(F.lit("")))
    return vault.vault_notes(c.select(F.concat(F.lit("/v/"), name(F.col("turn")), F.lit(".md")).alias("path"), text.alias("text")))


@query("""select '/v/c' || conv_id || 't' || turn || '.md' as path, 'Turn ' || conv_id || ' ' || turn as title, role || ',note,inline' as tags, case when turn > 0 then 'FOLLOWS>c' || conv_id || 't' || (turn - 1) else '>nowhere' end as links from conversations""")
def vault_notes(spark, sf):
    links = F.array_join(F.transform("links", lambda x: F.concat(F.coalesce(x["rel_type"], F.lit("")), F.lit(">"), x["target"])), ",")
    return _vault(spark, sf).select("path", "title", F.array_join("tags", ",").alias("tags"), links.alias("links"))


@query("""select '/v/c' || a.conv_id || 't' || a.turn || '.md' as src, '/v/c' || a.conv_id || 't' || (a.turn - 1) || '.md' as dst, 'FOLLOWS' as rel_type
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1""")
def resolve_links(spark, sf):
    return vault.resolve_links(_vault(spark, sf))[0]


@query("""select count(*) as notes, count_if(b.conv_id is not null) as relations, cast(count_if(b.conv_id is null) as bigint) as unresolved from (select *, cast(turn - 1 as bigint) as t from conversations) a left join conversations b on a.conv_id = b.conv_id and b.turn = a.t""".replace("count_if(b.conv_id is not null)", "cast(count_if(b.conv_id is not null) as bigint)"))
def vault_report(spark, sf):
    v = _vault(spark, sf)
    return vault.vault_report(v, *vault.resolve_links(v))


@query("""select coalesce(source, '') as folder, 'text' as format, cast(1 as bigint) as files, cast(sum(strlen(text) + 1) as bigint) as bytes from documents where text is not null group by 1""")
def scan_catalog(spark, sf):
    """Catalog of files that Spark writes, one folder per source."""
    d = table(spark, sf, "documents").filter("text is not null").select(F.col("text").alias("value"), F.concat(F.lit("s"), F.coalesce("source", F.lit(""))).alias("source")).repartition("source")
    # Spark's own part files end in .txt, one per source; a line end follows each text
    found = files.scan_catalog(spark, [_written(d, spark, by="source")])
    folder = F.url_decode(F.url_decode(F.regexp_extract("rel", "source=s([^/]*)/", 1)))
    return found.groupBy(folder.alias("folder"), "format").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


# ---- streams: the events, written as several files and read as a stream


def _event_stream(spark, sf, parts: int = 4):
    """The events as files in time order, and the stream over them."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(parts, "ts").sortWithinPartitions("ts", "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(folder), folder


@query(f"""with u as (select user_id as key, ts, cast(floor(value) as int) as pos, row_number() over (partition by user_id order by ts desc) as n from events)
select key, pos from u where n = 1""")
def progress_stream(spark, sf):
    stream, _ = _event_stream(spark, sf)
    out = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    updates = stream.selectExpr("user_id as key", "cast(ts as string) as ts", "cast(floor(value) as int) as pos")
    streams.progress_stream(updates, f"{out}/t", f"{out}/_c").awaitTermination()
    return streams.current_progress(spark, f"{out}/t").select("key", "pos")


@query(f"""with u as (select user_id as key, ts, event_id, max(ts) over (partition by user_id) as last from events) select key, count(*) as late from u where ts < last - interval 20 days group by key""")
def late_rows(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    seen = e.groupBy("key").agg((F.max("ts") - F.expr("interval 20 days")).alias("ts"))
    return streams.split_late(e, seen)[1].groupBy("key").agg(F.count(F.lit(1)).alias("late"))


@query("""with s as (select user_id as path, event_id as size, case when event_type = 'error' then null else event_type end as text, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type <> 'error')
select path, size, text from s where n = 1""")
def index_stream(spark, sf):
    """Every event is a changed file of its user; an error is one whose extraction failed."""
    stream, _ = _event_stream(spark, sf, 3)
    out = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    changed = stream.selectExpr("user_id as path", "struct(ts, event_id) as mark", "event_id as size", "case when event_type = 'error' then null else event_type end as text")
    streams.index_stream(changed, f"{out}/t", f"{out}/_c").awaitTermination()
    return streams.current_index(spark, f"{out}/t").select("path", "size", "text")


@query(library_queries.ORACLE_SQL["schedule_reviews"])
def review_states_by_fold(spark, sf):
    """The streaming fold's Python step over the batch log, in groups; equals the native fold."""
    log = V.frame(spark, sf, V.REVIEW_LOG)

    def fold(pdf):
        import pandas as pd

        state = None
        for r in pdf.sort_values(["day", "event_id", "grade"]).itertuples():
            state = streams.fold_review(state, pd.Timestamp(r.day).date(), int(r.grade))
        return pd.DataFrame([(pdf["card_id"].iloc[0], *state)], columns=["card_id", "stability", "difficulty", "interval", "reps", "lapses", "last_review", "next_review"])

    out = log.groupBy("card_id").applyInPandas(fold, f"card_id long, {streams.STATE}")
    days = {c: F.col(c).cast("string") for c in ("last_review", "next_review")}
    return out.withColumns({"stability": F.round("stability", 3), "difficulty": F.round("difficulty", 3), **days})

