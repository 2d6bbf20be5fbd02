"""Queries on search, listings, merges, reviews, sessions and the note graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import graph as G
from folioframe.operators import listing as L
from folioframe.operators import merge as M
from folioframe.operators import review as R
from folioframe.operators import search as S
from folioframe.operators import sessions
from folioframe.plans import views as V
from folioframe.session import table

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


def _docs(spark, sf):
    return table(spark, sf, "documents").withColumn("title", F.substring("text", 1, 40))


NOTES, EDGES, LIBRARY, TICKS, LOG = map(V.plain, (V.NOTES, V.EDGES, V.LIBRARY, V.TICKS, V.REVIEW_LOG))
LOCAL, REMOTE = V.plain(V.LOCAL_PROGRESS), V.plain(V.REMOTE_PROGRESS)


# ---- search


_HITS = """
with d as (select doc_id, substr(text, 1, 40) as title, text, lower(text) as low from documents),
h as (select *, cast((length(low) - length(replace(low, 'tion', ''))) / 4 as bigint) as hits, instr(low, 'tion') as pos from d where contains(low, 'tion')),
s as (select *, greatest(1, pos - 60) as a, least(length(text) + 1, pos + 64) as b from h)
select doc_id, title, hits,
  case when a > 1 then '…' else '' end || trim(replace(substr(text, a, b - a), chr(10), ' '), ' ') || case when b <= length(text) then '…' else '' end as snippet
from s order by hits desc, lower(title), doc_id limit 200"""


@query(_HITS)
def search_content(spark, sf):
    return S.search_content(_docs(spark, sf), "  TION ")


@query("select doc_id from documents where contains(lower(text), 'ening')")
def content_hits(spark, sf):
    return S.content_hits(table(spark, sf, "documents"), "ening")


@query("""select doc_id, cast(i - 1 as int) as "offset" from (select doc_id, lower(text) as low, unnest(range(1, length(text) + 1)) as i from documents where contains(lower(text), 'nin')) x
where substr(low, i, 3) = 'nin'""")
def find_all(spark, sf):
    return S.find_all(table(spark, sf, "documents"), "nin")


@query("""select doc_id, cast(n - 1 as int) as line, array_to_string(regexp_extract_all(t, '[A-Z][a-z]+ing'), ' ') as matches
from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) x where regexp_matches(t, '[A-Z][a-z]+ing')""")
def find_regex(spark, sf):
    return S.find_regex(table(spark, sf, "documents"), "[A-Z][a-z]+ing").withColumn("matches", F.array_join("matches", " "))


@query("""select doc_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 as bigint) as replaced, md5(replace(text, 'the', 'THE')) as digest from documents""")
def replace_all(spark, sf):
    return S.replace_all(table(spark, sf, "documents"), "the", "THE").select("doc_id", "replaced", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""with n as ({NOTES}) select id, doc from n where contains(lower(tag), 'user') and (contains(lower(note), 'the') or contains(lower(anchor), 'the') or contains(lower(tag), 'the'))""")
def match_notes(spark, sf):
    notes = V.frame(spark, sf, V.NOTES).withColumn("tags", F.array("tag"))
    return S.match_notes(notes, "#User the").select("id", "doc")


@query(f"""with l as ({LIBRARY}) select path, title from l where contains(lower(title || path || folder), 'the') and contains(lower(title || path || folder), 'src1')""")
def filter_listing(spark, sf):
    return S.filter_listing(V.frame(spark, sf, V.LIBRARY), "the SRC1", ("title", "path", "folder")).select("path", "title")


@query(f"""with l as (select doc_id as path, substr(text, 1, 40) as title, source as author, text from documents),
n as (select doc, string_agg(note, ' ' order by id) as notes from ({NOTES}) x group by doc)
select path, title, author from l left join n on l.path = n.doc
where (contains(lower(concat_ws(' ', title, path, author, notes)), 'ering') or contains(lower(text), 'ering')) and contains(lower(author), 'src1')""")
def search_library(spark, sf):
    docs = table(spark, sf, "documents")
    lib = docs.select(F.col("doc_id").alias("path"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("author"))
    return S.search_library(lib, V.frame(spark, sf, V.NOTES), query="ering", author="SRC1", content=S.content_hits(docs, "ering"))


@query("""select p_partkey, isbn, case when length(isbn) = 13 then
  list_sum([cast(substr(isbn, i, 1) as int) * case when i % 2 = 1 then 1 else 3 end for i in range(1, 14)]) % 10 = 0 else false end as valid
from (select p_partkey, '978' || lpad(cast(p_partkey * 7919 % 10000000000 as varchar), 10, '0') as isbn from part) x""")
def valid_isbn(spark, sf):
    isbn = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919 % 10_000_000_000).cast("string"), 10, "0"))
    return table(spark, sf, "part").select("p_partkey", isbn.alias("isbn")).withColumn("valid", T.valid_isbn(F.col("isbn")))


# ---- listings


_STATS = "select user_id as path, sum(value) as seconds, cast(count(*) as bigint) as words_read, cast(floor(max(value)) as int) % 100 as pct, concat('user ', user_id, ' ', repeat('x', cast(user_id % 60 as int))) as title from {events} group by user_id"
_POSITIONS = "select user_id as path, cast(max(event_id) % 100 as int) as pct from {events} where event_type = 'purchase' group by user_id"


@query(f"""with l as ({LIBRARY}), s as ({V.plain(_STATS)}), p as ({V.plain(_POSITIONS)})
select l.path, l.title, coalesce(p.pct, s.pct, 0) as pct, cast(round(coalesce(s.seconds, 0), 3) as double) as seconds from l left join p on l.path = p.path left join s on l.path = s.path""")
def library_entries(spark, sf):
    out = L.library_entries(V.frame(spark, sf, V.LIBRARY), V.frame(spark, sf, _POSITIONS), V.frame(spark, sf, _STATS).drop("title"))
    return out.select("path", "title", "pct", F.round("seconds", 3).alias("seconds"))


@query(f"""with f as (select path, title, cast(n_chars % 100 as int) as pct from ({LIBRARY}) l), s as ({V.plain(_POSITIONS)}), r as (select path * 7 as path, title, pct from ({V.plain(_STATS)}) y)
select f.path, f.title, coalesce(s.pct, f.pct) as pct, 'folder' as source, 0 as part from f left join s on f.path = s.path
union all select path, title, pct, 'recent', 1 from r where path not in (select path from f)""")
def combined_listing(spark, sf):
    files = V.frame(spark, sf, V.LIBRARY).select("path", "title", (F.col("n_chars") % 100).cast("int").alias("pct"))
    return L.combined_listing(files, V.frame(spark, sf, _STATS).select((F.col("path") * 7).alias("path"), "title", "pct"), V.frame(spark, sf, _POSITIONS))


_PATHS = "concat('/lib/', lang, '/', source, '/', case when doc_id % 4 = 0 then 'deep/' else '' end, doc_id, '.txt')"
_FOLDERS = "select distinct concat('/lib/', lang) as folder from {documents} union select distinct concat('/lib/', lang, '/', source) from {documents} where lang <> 'de' union select distinct concat('/lib/', lang, '/', source, '/deep') from {documents} where lang = 'fr'"


@query(f"""with p as (select {_PATHS} as path from documents), f as ({V.plain(_FOLDERS)}),
m as (select path, folder, row_number() over (partition by path order by length(folder) desc) as n from p join f on starts_with(path, folder || '/'))
select path, folder, substr(path, length(folder) + 2) as rel from m where n = 1""")
def owning_folder(spark, sf):
    return L.owning_folder(table(spark, sf, "documents").selectExpr(f"{_PATHS} as path"), V.frame(spark, sf, _FOLDERS))


@query(f"""with p as (select {_PATHS} as path from documents), f as ({V.plain(_FOLDERS)}),
m as (select path, folder, row_number() over (partition by path order by length(folder) desc) as n from p join f on starts_with(path, folder || '/')),
o as (select path, regexp_extract(folder, '[^/]+$') as name, substr(path, length(folder) + 2) as rel from m where n = 1),
g as (select source as name, concat(doc_id, '.txt') as rel, cast(n_chars % 100 as int) as pct from documents)
select o.name, o.rel, o.path, g.pct from o left join g on o.name = g.name and o.rel = g.rel""")
def progress_lookup(spark, sf):
    d = table(spark, sf, "documents")
    progress = d.selectExpr("source as folder", "concat(doc_id, '.txt') as rel", "cast(n_chars % 100 as int) as pct")
    return L.progress_lookup(d.selectExpr(f"{_PATHS} as path"), V.frame(spark, sf, _FOLDERS), progress).select("name", "rel", "path", "pct")


@query("""with s as (select user_id as path, max(ts) as ts from events group by user_id)
select path from (select path, row_number() over (order by ts desc, path) as n, count(*) over () as c from s) x where c <= 100 or n <= least(100, c - 20)""")
def keep_newest(spark, sf):
    stats = table(spark, sf, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("ts"))
    return L.keep_newest(stats, cap=100, drop=20).select("path")


@query("select user_id as path, min(ts) as first_opened from events group by user_id order by first_opened desc, path limit 20")
def recent_list(spark, sf):
    return L.recent_list(table(spark, sf, "events").select(F.col("user_id").alias("path"), "ts"))


@query(f"select round(sum(seconds), 2) as seconds, cast(sum(words_read) as bigint) as words, count(*) as documents from ({V.plain(_STATS)}) s")
def reading_totals(spark, sf):
    return L.reading_totals(V.frame(spark, sf, _STATS)).withColumn("seconds", F.round("seconds", 2))


@query(f"""select path, case when length(title) > 49 then substr(title, 1, 48) || '…' else title end as title, round(seconds, 3) as seconds from ({V.plain(_STATS)}) s order by s.seconds desc, path limit 10""")
def most_read(spark, sf):
    return L.most_read(V.frame(spark, sf, _STATS)).withColumn("seconds", F.round("seconds", 3))


@query(f"""with s as ({V.plain(_STATS)}), n as (select doc as path, count(*) as annotations from ({NOTES}) x group by doc)
select coalesce(s.path, n.path) as path, coalesce(annotations, 0) as annotations, words_read from s full join n on s.path = n.path""")
def portable_meta(spark, sf):
    return L.portable_meta(V.frame(spark, sf, _STATS), V.frame(spark, sf, V.NOTES)).select("path", "annotations", "words_read")


# ---- merges


@query(f"""with a as ({V.plain(V.INDEX_OLD)}), b as ({V.plain(V.INDEX_NEW)}),
j as (select coalesce(b.path, a.path) as path, a.path as o, b.path as n, a.size as os, b.size as ns, a.text as ot, b.text as nt from a full join b on a.path = b.path),
k as (select *, case when n is null then 'drop' when o is not null and os = ns then 'reuse' when nt is not null then 'extract' when o is not null then 'stale' else 'failed' end as action from j)
select path, case when action in ('reuse', 'stale') then os else ns end as size, action,
  md5(case when action in ('drop', 'failed') then null when action in ('reuse', 'stale') then ot else nt end) as digest from k""")
def refresh_index(spark, sf):
    return M.refresh_index(V.frame(spark, sf, V.INDEX_OLD), V.frame(spark, sf, V.INDEX_NEW), mark=("size",)).select("path", "size", "action", F.md5(F.col("text").cast("binary")).alias("digest"))


def _replicas(spark, sf):
    side = lambda v: V.frame(spark, sf, v).select(F.col("path").alias("key"), F.col("pos").alias("offset"), F.col("day").cast("string").alias("ts"))
    return side(V.LOCAL_PROGRESS), side(V.REMOTE_PROGRESS)


def _merge_sql(remote_wins: str, manual: bool = False) -> str:
    label = "'unresolved'" if manual else f"case when {remote_wins} then 'remote' else 'local' end"
    return f"""with a as ({LOCAL}), b as ({REMOTE}),
j as (select a.path as ak, b.path as bk, a.pos as ap, b.pos as bp, a.day as ad, b.day as bd from a full join b on a.path = b.path),
k as (select *, ak is not null and bk is not null and (ap <> bp or ad <> bd) as c from j),
r as (select *, ak is null or (c and {remote_wins}) as w from k)
select coalesce(ak, bk) as key, case when w then bp else ap end as "offset", cast(case when w then bd else ad end as varchar) as ts, case when c then {label} end as resolution from r"""


@query(_merge_sql("bd >= ad"))
def merge_progress_newest(spark, sf):
    return M.merge_progress(*_replicas(spark, sf))


@query(_merge_sql("(bp > ap or (bp = ap and bd > ad))"))
def merge_progress_highest(spark, sf):
    return M.merge_progress(*_replicas(spark, sf), policy="highest_progress", prefer="local")


@query(_merge_sql("false", manual=True))
def merge_progress_manual(spark, sf):
    return M.merge_progress(*_replicas(spark, sf), policy="manual")


@query(f"select resolution, count(*) as conflicts from ({_merge_sql('bd >= ad')}) m where resolution is not null group by resolution")
def conflict_report(spark, sf):
    return M.conflict_report(M.merge_progress(*_replicas(spark, sf)))


@query(_merge_sql("bd > ad").replace("as key", "as rel"))
def merge_meta(spark, sf):
    a, b = (x.withColumnRenamed("key", "rel") for x in _replicas(spark, sf))
    return M.merge_meta(a, b, prefer="local")


@query(f"""with n as ({NOTES}), a as (select doc, id, note, char_pos as pos, char_pos % 3 as ts from n where char_pos <> 2),
b as (select doc, id, concat(note, '!') as note, char_pos as pos, 1 as ts from n where char_pos <> 3)
select coalesce(a.doc, b.doc) as doc, coalesce(a.id, b.id) as id, case when a.id is null or 1 >= a.ts and b.id is not null then b.note else a.note end as note from a full join b on a.doc = b.doc and a.id = b.id
union all select doc, null, note from n where char_pos = 0 union all select doc, null, concat(note, '?') from n where char_pos = 1""")
def merge_notes(spark, sf):
    n = V.frame(spark, sf, V.NOTES)
    none = F.lit(None).cast("long").alias("id")
    a = n.filter("char_pos <> 2").select("doc", "id", "note", F.col("char_pos").alias("pos"), (F.col("char_pos") % 3).alias("ts"))
    a = a.unionByName(n.filter("char_pos = 0").select("doc", none, "note", F.col("char_pos").alias("pos"), F.lit(0).alias("ts")))
    b = n.filter("char_pos <> 3").select("doc", "id", F.concat("note", F.lit("!")).alias("note"), F.col("char_pos").alias("pos"), F.lit(1).alias("ts"))
    b = b.unionByName(n.filter("char_pos = 1").select("doc", none, F.concat("note", F.lit("?")).alias("note"), F.col("char_pos").alias("pos"), F.lit(0).alias("ts")))
    return M.merge_notes(a, b).select("doc", "id", "note")


@query("""with a as (select c_custkey as id, c_name as title, c_mktsegment as doi from customer where c_mktsegment <> 'BUILDING'),
b as (select c_custkey as id, case when c_nationkey % 2 = 0 then upper(c_name) || '!' end as title, c_mktsegment || '#' as doi from customer where c_mktsegment <> 'MACHINERY')
select coalesce(a.id, b.id) as id, coalesce(b.title, a.title) as title, coalesce(b.doi, a.doi) as doi from a full join b on a.id = b.id""")
def upsert_citations(spark, sf):
    c = table(spark, sf, "customer")
    a = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("doi"))
    b = c.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.upper("c_name"), F.lit("!"))).alias("title"), F.concat("c_mktsegment", F.lit("#")).alias("doi"))
    return M.upsert_citations(a, b)


# ---- reviews


_W = R.WEIGHTS
#: Reviews that share day and event go by grade, as the fold takes them; states have four decimals, and the fifth of a thousandth goes up.
_FSRS = f"""with recursive g as ({LOG}), o as (select card_id, day, grade, row_number() over (partition by card_id order by day, event_id, grade) as n from g),
f as (
  select card_id, n, day, cast(case grade when 1 then {_W[0]} when 2 then {_W[1]} when 3 then {_W[2]} else {_W[3]} end as double) as s,
    round_even(least(greatest({_W[4]} - exp({_W[5]}::double * (grade - 1)) + 1, 1.0), 10.0)::double, 4) as d, case when grade = 1 then 1 else 0 end as lapses, grade
  from o where n = 1
  union all
  select card_id, n, day, round_even(case when grade = 1 then greatest(least({_W[11]} * pow(d, -{_W[12]}) * (pow(s + 1, {_W[13]}) - 1) * exp({_W[14]}::double * (1 - r)), s), 0.1)
      else s * (exp({_W[8]}::double) * (11 - d) * pow(s, -{_W[9]}) * (exp({_W[10]}::double * (1 - r)) - 1) * (case when grade = 2 then {_W[15]} else 1 end) * (case when grade = 4 then {_W[16]} else 1 end) + 1) end::double, 4) as s,
    round_even(least(greatest({_W[7]} * least(greatest({_W[4]} - exp({_W[5]}::double * 3) + 1, 1.0), 10.0) + (1 - {_W[7]}) * (d - {_W[6]} * (grade - 3) * ((10 - d) / 9)), 1.0), 10.0)::double, 4) as d,
    lapses + case when grade = 1 then 1 else 0 end, grade
  from (select o.card_id, o.n, o.day, o.grade, f.s, f.d, f.lapses, pow(1 + 19.0::double / 81.0 * greatest(o.day - f.day, 0) / f.s, -0.5) as r from f join o on o.card_id = f.card_id and o.n = f.n + 1) x
)
"""
_LAST = """, l as (select *, cast(case when grade = 1 then 1 else least(greatest(round_even(s / (19.0::double / 81) * (pow(0.9::double, -2) - 1), 0), 1), 36500) end as int) as "interval"
from f where (card_id, n) in (select card_id, max(n) from o group by card_id))
"""


@query(_FSRS + _LAST + """select card_id, cast(round(cast(s as decimal(38, 4)), 3) as double) as stability, cast(round(cast(d as decimal(38, 4)), 3) as double) as difficulty, "interval", cast(n as int) as reps, cast(lapses as int) as lapses, cast(day as varchar) as last_review, cast(cast(day + "interval" as date) as varchar) as next_review from l""")
def schedule_reviews(spark, sf):
    s = F.col("state")
    out = R.schedule_reviews(V.frame(spark, sf, V.REVIEW_LOG))
    return out.select("card_id", F.round(s["stability"], 3).alias("stability"), F.round(s["difficulty"], 3).alias("difficulty"), s["interval"].alias("interval"), s["reps"].alias("reps"), s["lapses"].alias("lapses"), s["last_review"].cast("string").alias("last_review"), s["next_review"].cast("string").alias("next_review"))


@query(f"""with recursive g as ({LOG}), o as (select card_id, day, grade, row_number() over (partition by card_id order by day, event_id) as n from g),
f as (select card_id, cast(0 as bigint) as n, cast(null as date) as day, 0 as reps, 0 as lapses, 0 as ivl, cast(2.5 as double) as ease from (select distinct card_id from o) z
union all select o.card_id, o.n, o.day, f.reps + 1, f.lapses + case when grade = 1 then 1 else 0 end,
  cast(case when grade = 1 or f.reps = 0 then 1 when f.reps = 1 then 6 else greatest(round_even(f.ivl * f.ease, 0), 1) end as int),
  round_even(greatest(1.3, f.ease + (0.1 - (5 - (grade + 1)) * (0.08 + (5 - (grade + 1)) * 0.02)))::double, 4)
from f join o on o.card_id = f.card_id and o.n = f.n + 1)
select card_id, ivl as "interval", reps, lapses, round(ease, 3) as ease, cast(cast(day + ivl as date) as varchar) as next_review from f where (card_id, n) in (select card_id, max(n) from o group by card_id)""")
def schedule_reviews_sm2(spark, sf):
    s = F.col("state")
    log = V.frame(spark, sf, V.REVIEW_LOG)
    return R.schedule_reviews(log, rule="sm2").select("card_id", s["interval"].alias("interval"), s["reps"].alias("reps"), s["lapses"].alias("lapses"), F.round(s["ease"], 3).alias("ease"), F.regexp_replace(s["next_review"].cast("string"), r"^\+", "").alias("next_review"))  # years of more than four digits have a sign


def _cards(spark, sf):
    return R.schedule_reviews(V.frame(spark, sf, V.REVIEW_LOG)).select(F.col("card_id").alias("id"), F.lit(1).alias("doc"), "state")


@query(_FSRS + _LAST + """select card_id as id, cast(day + "interval" - date '2024-02-10' as int) as days_until_due from l where day + "interval" <= date '2024-02-10'""")
def due_queue(spark, sf):
    return R.due_queue(_cards(spark, sf), "2024-02-10").select("id", "days_until_due")


@query(_FSRS + _LAST + """select count(*) as total, cast(count_if(day + "interval" <= date '2024-02-10') as bigint) as due, cast(0 as bigint) as "new", count(*) as reviewed,
round(avg(round_even(pow(1 + 19.0::double / 81 * greatest(date '2024-02-10' - day, 0) / s, -0.5), 4)), 3) as retention from l""")
def review_summary(spark, sf):
    return R.review_summary(_cards(spark, sf), "2024-02-10").withColumn("retention", F.round("retention", 3))


# ---- sessions


_SESSIONS = f"""with t as ({TICKS}), m as (select *, lag(ts) over w as before, coalesce(lag(doc) over w = doc and lag(speaking) over w and speaking and ts - lag(ts) over w <= interval 12 hours, false) as on_ from t window w as (partition by reader order by ts, event_id)),
s as (select *, sum(case when on_ then 0 else 1 end) over (partition by reader order by ts, event_id) as session from m)
select reader, doc, cast(session as bigint) as session, min(ts) as started, max(ts) as ended, round(sum(case when on_ then epoch_us(ts) - epoch_us(before) else 0 end) / 1e6, 3) as seconds, count(*) as ticks, max(word_idx) + 1 as words_read
from s where speaking group by reader, doc, session"""


@query(_SESSIONS)
def reading_sessions(spark, sf):
    return sessions.reading_sessions(V.frame(spark, sf, V.TICKS)).withColumn("seconds", F.round("seconds", 3))


# ---- graph


def _graph(spark, sf):
    return V.frame(spark, sf, V.NOTES).withColumn("tags", F.array("tag")), V.frame(spark, sf, V.EDGES)


@query(f"""with n as ({NOTES}), e as ({EDGES}) select src, dst, rel_type, n.anchor from e left join n on e.dst = n.id""")
def neighbors(spark, sf):
    return G.neighbors(*_graph(spark, sf)).select("src", "dst", "rel_type", F.col("other.anchor").alias("anchor"))


@query(f"""with n as ({NOTES}), e as ({EDGES}) select src, dst, rel_type, n.anchor from e left join n on e.src = n.id""")
def reverse_neighbors(spark, sf):
    return G.reverse_neighbors(*_graph(spark, sf)).select("src", "dst", "rel_type", F.col("other.anchor").alias("anchor"))


@query(f"""with n as ({NOTES}), e as ({EDGES}) select src, dst, rel_type from e where src in (select id from n) and dst in (select id from n)""")
def subgraph(spark, sf):
    return G.subgraph(*_graph(spark, sf)).select("src", "dst", "rel_type")


@query(f"""with n as ({NOTES}), e as ({EDGES}) select id from n where contains(lower(anchor || ' ' || note), 'the') and lower(tag) = 'user' and id in (select src from e where rel_type = 'FOLLOWS' union select dst from e where rel_type = 'FOLLOWS')""")
def search_graph(spark, sf):
    return G.search_graph(*_graph(spark, sf), query="The", tags=["USER"], rel_types=["FOLLOWS"]).select("id")


@query(f"""with n as ({NOTES}), e as ({EDGES}) select id, (select count(*) from e where src = id) as out_degree, (select count(*) from e where dst = id) as in_degree from n""")
def degree_stats(spark, sf):
    return G.degree_stats(*_graph(spark, sf))


_INSIDE = f"with recursive n as ({NOTES}), e as ({EDGES}), i as (select src, dst from e where src in (select id from n) and dst in (select id from n)), b as (select src, dst from i union select dst, src from i)"


@query(_INSIDE + ", r as (select cast(0 as bigint) as id union select b.dst from r join b on r.id = b.src) select id from r where id in (select id from n)")
def connected_component(spark, sf):
    return G.connected_component(*_graph(spark, sf), 0)


@query(_INSIDE + ", r as (select id, id as seed from n union select b.dst, r.seed from r join b on r.id = b.src) select id, min(seed) as component from r group by id")
def all_components(spark, sf):
    return G.all_components(*_graph(spark, sf))


@query(f"""with n as ({NOTES}) select id, doc, cast(id as varchar) as key from n""")
def build_graph_nodes(spark, sf):
    notes = V.frame(spark, sf, V.NOTES).withColumn("tags", F.array("tag")).withColumn("relations", F.array().cast("array<struct<rel_type:string,target_id:long,note:string>>"))
    nodes, _ = G.build_graph(notes)
    return nodes.select(F.col("id").cast("long").alias("id"), "doc", F.col("id").alias("key"))


_REL = "array(struct('supports it' as rel_type, conv_id as target_doc, conv_id * 100 + turn + 1 as target_id, 'n' as note))"


@query("""select conv_id * 100 + turn as src, conv_id * 100 + turn + 1 as dst, 'SUPPORTS_IT' as rel_type from conversations""")
def build_graph_edges(spark, sf):
    notes = table(spark, sf, "conversations").selectExpr("conv_id as doc", "conv_id * 100 + turn as id", "cast(turn as int) as char_pos", "text as anchor", "text as note", "array(role) as tags", f"{_REL} as relations")
    return G.build_graph(notes)[1].select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "rel_type")


@query("""select a.conv_id as doc, a.conv_id * 100 + a.turn as id, a.conv_id * 100 + a.turn + 1 as target_id, b.text as target_note
from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1""")
def related_notes(spark, sf):
    notes = table(spark, sf, "conversations").selectExpr("conv_id as doc", "conv_id * 100 + turn as id", "text as anchor", "text as note", f"{_REL} as relations")
    return G.related_notes(notes).select("doc", "id", "target_id", F.col("target.note").alias("target_note"))


@query(f"""with e as (select src, dst, rel_type, cast(row_number() over (partition by src order by dst) - 1 as int) as position from ({EDGES}) x)
select src, dst from e where not (src % 200 = 0 and position = 0)
union all select conv_id * 100, conv_id * 100 + 1 from conversations where turn = 0 and conv_id % 4 = 1""")
def apply_edge_changes(spark, sf):
    from pyspark.sql import Window

    nodes, edges = _graph(spark, sf)
    edges = edges.withColumn("position", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    turns = table(spark, sf, "conversations").filter("turn = 0")
    adds = turns.filter("conv_id % 4 = 1").selectExpr("'add' as action", "conv_id * 100 as src", "conv_id * 100 + 1 as dst", "'SEE_ALSO' as rel_type", "cast(null as int) as position", "conv_id as seq")
    unknown = turns.limit(1).selectExpr("'add' as action", "-1L as src", "0L as dst", "'SEE_ALSO' as rel_type", "cast(null as int) as position", "conv_id as seq")
    removals = edges.select("src").distinct().filter("src % 200 = 0").selectExpr("'remove' as action", "src", "cast(null as long) as dst", "cast(null as string) as rel_type", "0 as position", "src as seq")
    return G.apply_edge_changes(nodes, edges, adds.unionByName(unknown).unionByName(removals))[0].select("src", "dst")
