"""Queries on text shaping, mining and normalisation.

The documents hold no Markdown, so outlines, chapters, tables, footnotes and
numbers are tested on texts that Spark builds from the order tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import normalize as N
from folioframe.functions import text as T
from folioframe.operators import mining as M
from folioframe.operators import search
from folioframe.operators import shaping as S
from folioframe.plans import views as V
from folioframe.session import dealt, materialize, table

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
    return table(spark, sf, "documents")


def _dealt(spark, sf):
    """The documents, for work that takes long per text."""
    return dealt(table(spark, sf, "documents"), "doc_id")


def _listed(spark, sf):
    """The words' frequencies, counted once and written, so that a broadcast of them waits for no other stage."""
    return materialize(M.token_frequencies(_dealt(spark, sf)), "frequencies")


# ---- words, time, pages


_TOKENS = "tok as (select doc_id, regexp_extract_all(text, '[^\\s]+') as ws from documents), w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as n from tok)"


@query(f"""with {_TOKENS}, s as (select *, sum(length(word) + 1) over (partition by doc_id order by n) as u, sum(length(word) + 1) over (partition by doc_id) as t from w)
select doc_id, cast(n - 1 as int) as n, word, round(60.0::double * (u - length(word) - 1) / t, 6) as start_s, round(60.0::double * u / t, 6) as end_s from s""")
def allocate_time(spark, sf):
    return S.allocate_time(_docs(spark, sf), F.lit(60.0)).select("doc_id", "n", "word", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"""with {_TOKENS}, g as (select doc_id, n, word, length(word) as l from w),
p as (select doc_id, unnest(string_split_regex(text, '[^\\s]+')) as gap, generate_subscripts(string_split_regex(text, '[^\\s]+'), 1) as n from documents),
j as (select g.doc_id, g.n, word, l, sum(l + length(gap)) over (partition by g.doc_id order by g.n) as e from g join p on g.doc_id = p.doc_id and g.n = p.n)
select doc_id, count(*) as words, cast(sum(e - l) as bigint) as starts, cast(max(e) as bigint) as last from j group by doc_id""")
def tokens_with_offsets(spark, sf):
    return S.tokens_of(_docs(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum("start").alias("starts"), F.max("end").cast("long").alias("last"))


@query("""with t as (select doc_id, cast(x as int) as "offset" from documents, (values (0), (100), (1000), (1000000)) v(x)),
w as (select doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\\s]+'), 1) as n from documents),
p as (select doc_id, unnest(string_split_regex(text, '[^\\s]+')) as gap, generate_subscripts(string_split_regex(text, '[^\\s]+'), 1) as n from documents),
o as (select w.doc_id, w.n, sum(length(word) + length(gap)) over (partition by w.doc_id order by w.n) - length(word) as s from w join p on w.doc_id = p.doc_id and w.n = p.n)
select t.doc_id, t."offset", cast(coalesce(min(case when s >= t."offset" then n end), max(n)) - 1 as int) as idx from t join o on t.doc_id = o.doc_id group by t.doc_id, t."offset" """)
def word_at_offset(spark, sf):
    d = _docs(spark, sf)
    targets = d.select("doc_id", F.explode(F.array(*map(F.lit, (0, 100, 1000, 1_000_000)))).alias("offset"))
    return S.word_at_offset(S.tokens_of(d), targets)


@query("""with recursive b as (select doc_id, len(regexp_extract_all(text, '[^\\s]+')) as n from documents),
k as (select doc_id, n, unnest(range(40, greatest(n, 41), 40)) as s from b),
r as (select doc_id, n, 0 as page, cast(0 as bigint) as start from b
union all select r.doc_id, r.n, r.page + 1, (r.start + 240) // 40 * 40 from r where (r.start + 200 + 39) // 40 * 40 < r.n)
select doc_id, cast(page as int) as page, cast(start as int) as start from (select doc_id, n, 0 as page, 0 as start from b
union all select doc_id, n, (s // 200), s from k where s % 200 = 0 and s < n) x""")
def paginate(spark, sf):
    words = _dealt(spark, sf).select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n_words"))
    blocks = words.withColumn("block_starts", F.sequence(F.lit(0), F.greatest("n_words", F.lit(1)), F.lit(40)))
    return S.paginate(blocks, words_per_page=200).select("doc_id", "page", "start")


@query("""with p as (select doc_id, list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: case when length(x) > 800 then regexp_replace(x, '([.!?…])\\s+', '\\1 ', 'g') else x end) as ps from documents where length(text) > 0)
select doc_id, md5(array_to_string(ps, chr(10) || chr(10))) as digest, true as bounded from p""")
def chunk_text(spark, sf):
    chunks = S.chunk_text(_dealt(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\n\n")), limit=800)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("chunk", "sep").alias("t")))), lambda x: x["t"])
    return chunks.groupBy("doc_id").agg(F.md5(F.array_join(parts, "").cast("binary")).alias("digest"), (F.max(F.length("chunk")) <= 800).alias("bounded"))


@query()
def sentence_spans(spark, sf):
    return S.sentence_spans(_dealt(spark, sf))


@query()
def sentence_timing(spark, sf):
    return S.sentence_timing(_dealt(spark, sf), F.lit(60.0))


@query()
def pack_cues(spark, sf):
    return S.pack_cues(_dealt(spark, sf), F.lit(60.0))


@query("""with l as (select source, doc_id, regexp_replace(regexp_replace(lower(trim(unnest(string_split(text, chr(10))), ' ')), '\\s+', ' ', 'g'), '[0-9]+', '#', 'g') as key from documents),
k as (select distinct source, doc_id, key from l where key <> ''), a as (select source, count(distinct doc_id) as n from l group by source)
select k.source, key, count(*) as members from k join a on k.source = a.source group by k.source, key, n having n >= 3 and count(*) >= greatest(2, ceil(n * 0.02))""")
def recurring_lines(spark, sf):
    return S.recurring_lines(S.lines_of(_docs(spark, sf)).join(_docs(spark, sf).select("doc_id", "source"), "doc_id"), group="source", member="doc_id", least=2, share=0.02)


@query("""with o as (select l_orderkey as doc_id, count(*) as k from lineitem group by l_orderkey), l as (select doc_id, k, unnest(range(0, 11 + k)) as n from o)
select doc_id, cast(n as int) as n, cast(case when n > 6 + k then 6 + k when n > 0 then 0 end as int) as prev_heading, cast(case when n < 6 + k then 6 + k end as int) as next_heading,
  cast(case when n > 9 + k then 9 + k when n > 6 + k then 6 + k when n > 3 then 3 else 0 end as int) as prev_paragraph,
  cast(case when n < 3 then 3 when n < 6 + k then 6 + k when n < 9 + k then 9 + k else 10 + k end as int) as next_paragraph, case when n > 3 then 3 end as prev_table, case when n < 3 then 3 end as next_table from l""")
def block_context(spark, sf):
    return S.block_context(_order_markdown(spark, sf))


# ---- texts built from the order tables


def _order_markdown(spark, sf):
    """One Markdown text per order: a heading and a table of its lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("| "), "l_linenumber", F.lit(" | "), F.col("l_quantity").cast("long").cast("string"), F.lit(" | "), "l_returnflag", F.lit(" |")).alias("row")))).alias("r")
    )
    body = F.concat(F.lit("# Order "), "l_orderkey", F.lit("\nIntro line.\n\n| no | quantity | mode |\n|---|---|---|\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("\n\n## Notes ##\nSee[^1] and[^b].\n\n[^1]: first\n[^b]: second"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("T"), "l_orderkey").alias("title"), body.alias("text"))


_LINES = "(select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, '| ' || l_linenumber || ' | ' || cast(l_quantity as bigint) || ' | ' || l_returnflag || ' |') as r, l_linenumber, cast(l_quantity as bigint) as q, l_returnflag from lineitem)"
#: The table of an order's text.
_TABLE = "'| no | quantity | mode |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || q || ' | ' || l_returnflag || ' |', chr(10) order by r)"


@query(f"""select doc_id, 1 as "table", cast(r as int) as row, 0 as col, 'no' as header, cast(l_linenumber as varchar) as cell from {_LINES} x
union all select doc_id, 1, cast(r as int), 1, 'quantity', cast(q as varchar) from {_LINES} x union all select doc_id, 1, cast(r as int), 2, 'mode', l_returnflag from {_LINES} x""")
def table_rows(spark, sf):
    return S.table_rows(_order_markdown(spark, sf))


@query(f"""select doc_id, 1 as "table", string_agg('Row ' || r || ': no is ' || l_linenumber || ', quantity is ' || q || ', mode is ' || l_returnflag || '.', chr(10) order by r) as narration from {_LINES} x group by doc_id""")
def narrate_tables(spark, sf):
    return S.narrate_tables(_order_markdown(spark, sf))


@query("""with n as (select l_orderkey as doc_id, count(*) as k from lineitem group by l_orderkey)
select doc_id, 0 as n, 1 as level, 'Order ' || doc_id as title, 1 as occurrence from n union all select doc_id, cast(6 + k as int), 2, 'Notes', 1 from n""")
def outline(spark, sf):
    return S.outline(_order_markdown(spark, sf))


@query(f"""select doc_id, 1 as chapter, 'Order ' || doc_id as title, 'Order ' || doc_id || chr(10) || 'Intro line.' || chr(10) || chr(10) || {_TABLE} as body from {_LINES} x group by doc_id
union all select distinct doc_id, 2, 'Notes', 'Notes' || chr(10) || 'See[^1] and[^b].' || chr(10) || chr(10) || '[^1]: first' || chr(10) || '[^b]: second' from {_LINES} x""")
def split_chapters(spark, sf):
    return S.split_chapters(_order_markdown(spark, sf))


@query(f"""select doc_id, '# Order ' || doc_id || chr(10) || 'Intro line.' || chr(10) || chr(10) || {_TABLE} || chr(10) || chr(10) || '## Notes ##' || chr(10) || 'See (first) and (second).' || chr(10) as text from {_LINES} x group by doc_id""")
def footnotes(spark, sf):
    return S.footnotes(_order_markdown(spark, sf))


@query(f"""select doc_id, 'Order ' || doc_id || ' Intro line.' || chr(10) || chr(10) || string_agg('Row ' || r || ': no is ' || l_linenumber || ', quantity is ' || q || ', mode is ' || l_returnflag || '.', ' ' order by r)
|| chr(10) || chr(10) || 'Notes See[^1] and[^b].' || chr(10) || chr(10) || '[^1]: first [^b]: second' as text from {_LINES} x group by doc_id""")
def strip_markdown(spark, sf):
    return _order_markdown(spark, sf).select("doc_id", N.strip_markdown(F.col("text")).alias("text"))


@query("""select o_orderkey, '# Order ' || o_orderkey || chr(10) || 'see **' || o_orderpriority || '** in Clerk 7 text' as text from orders""")
def wiki_to_markdown(spark, sf):
    wiki = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("== Order "), "o_orderkey", F.lit(" ==\n|-\nsee '''"), "o_orderpriority", F.lit("''' in [[Clerk|Clerk 7]] {{x}}[http://a.b text]")).alias("text"))
    return N.wiki_to_markdown(wiki, "mediawiki", key="o_orderkey")


_WORDS20 = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def _two_digits(n: str) -> str:
    return f"case when {n} < 20 then {_WORDS20}[{n} + 1] else {_TENS}[{n} // 10 + 1] || case when {n} % 10 > 0 then '-' || {_WORDS20}[{n} % 10 + 1] else '' end end"


_DAYS = "['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth','twentieth','twenty-first','twenty-second','twenty-third','twenty-fourth','twenty-fifth','twenty-sixth','twenty-seventh','twenty-eighth','twenty-ninth','thirtieth','thirty-first']"


@query(f"""with l as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as q, cast(l_shipdate as date) as d from lineitem)
select l_orderkey, l_linenumber, 'has ' || {_two_digits('q')} || ' percent on ' || strftime(d, '%B') || ' ' || {_DAYS}[day(d)] || ', ' || case when year(d) % 1000 = 0 then {_WORDS20}[year(d) // 1000 + 1] else {_two_digits('(year(d) // 100)')} end || ' ' ||
case when year(d) % 1000 = 0 then 'thousand' when year(d) % 100 = 0 then 'hundred' when year(d) % 100 < 10 then 'oh ' || {_two_digits('(year(d) % 100)')} else {_two_digits('(year(d) % 100)')} end || ', item ' || l_linenumber || '.' as text from l""")
def verbalize_numbers(spark, sf):
    text = F.concat(F.lit("has "), F.col("l_quantity").cast("long"), F.lit("% on "), F.col("l_shipdate").cast("date"), F.lit(", item "), "l_linenumber", F.lit("."))
    return N.verbalize_numbers(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text")))


@query()
def number_kinds(spark, sf):
    """The numbers of all documents by kind; SQL lacks the reading of runs from the left, a test holds brute force."""
    return N.number_table(_dealt(spark, sf)).groupBy("kind").agg(F.sum("count").alias("found"), F.count(F.lit(1)).alias("literals"))


@query("""with w as (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+') as ws from documents)
select doc_id, md5(array_to_string(list_transform(ws, lambda x: case lower(x) when 'the' then 'THEE' when 'of' then 'from' else x end), '')) as digest from w""")
def normalize_corpus(spark, sf):
    return N.normalize_corpus(_dealt(spark, sf), lexicon={"the": "THEE", "of": "from"}, numbers=False).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- mining


_WORDS = "w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents)"
_FREQ = "f as (select word, count(*) as count, count(distinct doc_id) as docs from w group by word), z as (select *, round(log10(count / sum(count) over () * 1e9), 4) as zipf from f)"


@query(f"with {_WORDS}, {_FREQ} select word, count, docs, zipf from z")
def token_frequencies(spark, sf):
    return M.token_frequencies(_docs(spark, sf))


@query(f"with {_WORDS}, {_FREQ} select distinct w.doc_id, w.word from w join z on w.word = z.word where length(w.word) >= 4 and zipf < 4.5")
def difficult_words(spark, sf):
    return M.difficult_words(_dealt(spark, sf), M.token_frequencies(_dealt(spark, sf)))


_KNOWN = "select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark"


@query(f"""with k as ({_KNOWN}), w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as word from documents)
select doc_id, word from w where not regexp_matches(word, '[0-9]') and word not in (select word from k)""")
def unknown_words(spark, sf):
    known = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return M.unknown_words(_docs(spark, sf), known)


@query("""with g as (select p_brand as word, 'noun' as pos, min(p_name) as definition from part group by p_brand), c as (select p_brand as word, 'verb' as pos, max(p_name) as definition from part where p_size > 40 and p_brand like '%1' group by p_brand)
select '"' || s.word || '!"' as word, coalesce(c.pos, g.pos) as pos, coalesce(c.definition, g.definition) as definition from (select distinct p_brand as word from part) s left join c on s.word = c.word left join g on s.word = g.word""")
def define_words(spark, sf):
    p = table(spark, sf, "part")
    g = p.groupBy(F.col("p_brand").alias("word")).agg(F.lit("noun").alias("pos"), F.min("p_name").alias("definition"))
    c = p.filter("p_size > 40 and p_brand like '%1'").groupBy(F.col("p_brand").alias("word")).agg(F.lit("verb").alias("pos"), F.max("p_name").alias("definition"))
    words = p.select(F.concat(F.lit('"'), F.lower("p_brand"), F.lit('!"')).alias("_l"), F.concat(F.lit('"'), "p_brand", F.lit('!"')).alias("word")).distinct().select("word")
    return M.define_words(words, g, c).select("word", "pos", "definition")


@query("""with d as (select doc_id, regexp_replace(text, '([^\\p{L}\\p{M}\\p{N}_])', '\\1\\1', 'g') as t from documents), m as (select doc_id, len(regexp_extract_all(t, '(?:^|[^\\p{L}\\p{M}\\p{N}_])[A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+){1,3}(?:$|[^\\p{L}\\p{M}\\p{N}_])')) as phrases from d)
select doc_id, cast(phrases as bigint) as phrases from m where phrases > 0""")
def capital_phrases(spark, sf):
    return M.spans_of(_docs(spark, sf), "(?U)" + M.CAP_PHRASE, "CONCEPT").groupBy("doc_id").agg(F.count(F.lit(1)).alias("phrases"))


@query()
def concept_spans(spark, sf):
    return M.concept_spans(_dealt(spark, sf), "medical")


@query()
def distinct_concepts(spark, sf):
    return M.distinct_concepts(M.concept_spans(_dealt(spark, sf), "medical"))


@query("""with c as (select lower(p_brand) as c, min(p_brand) as concept from part group by lower(p_brand)), n as (select p_partkey as id, lower(p_name || ' ' || p_brand || ' ' || p_type) as hay from part)
select concept, array_to_string(list_sort(list(distinct id)), ',') as ids from c join n on contains(hay, c) group by concept""")
def suggest_links(spark, sf):
    p = table(spark, sf, "part")
    concepts = p.select(F.col("p_brand").alias("text"), F.lit(0).alias("first"))
    notes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("anchor"), F.concat_ws(" ", "p_brand", "p_type").alias("note"))
    return M.suggest_links(concepts, notes).withColumn("ids", F.array_join("ids", ","))


@query()
def cloze_cards(spark, sf):
    return M.cloze_cards(_dealt(spark, sf), frequencies=_listed(spark, sf))


@query()
def summarize(spark, sf):
    return M.summarize(_dealt(spark, sf))


@query("""with a as (select doc_id, len(regexp_extract_all(text, '[^\\s]+')) as n from documents where text is not null)
select doc_id, cast(n + 2 as bigint) as words, cast(n * (n - 1) // 2 as bigint) as places from a""")
def align_tokens(spark, sf):
    """Texts with words before them that are spoken only, and words behind them that are shown only."""
    d = _dealt(spark, sf).select("doc_id", F.concat(F.lit("[[table]] [[row]] "), "text").alias("spoken"), F.concat("text", F.lit(" {{footer}}")).alias("rendered"))
    return M.align_tokens(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum("offset").alias("places"))


@query("""with k as (select p_brand || '-' || p_size as doc_id, count(*) as k from part group by 1) select doc_id, cast(8 * k as bigint) as words, cast(8 * k * (k + 1) + 3 * k - 6 as bigint) as places from k""")
def align_narration(spark, sf):
    """Tables of parts as they are narrated, against the words as they are shown."""
    p = table(spark, sf, "part").groupBy(F.concat_ws("-", "p_brand", "p_size").alias("doc_id")).agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))
    lines = lambda form, sep: F.array_join(F.transform("parts", lambda x: F.replace(F.lit(form), F.lit("#"), x.cast("string"))), sep)
    p = p.select("doc_id", F.concat(F.lit("| Part | Size |\n| --- | --- |\n"), lines("| p# | s# |", "\n")).alias("text"), F.concat(F.lit("part size "), lines("P# S#", " ")).alias("rendered"))
    said = S.narrate_tables(p).select("doc_id", F.col("narration").alias("spoken"))
    return M.align_tokens(p.join(said, "doc_id"), word=r"\w+", fold=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.sum("offset").alias("places"))


@query(f"""with {_TOKENS}, {_WORDS.replace("w as", "lw as")}, {_FREQ.replace("from w ", "from lw ")}, h as (select distinct lw.doc_id, lw.word from lw join z on lw.word = z.word where length(lw.word) >= 4 and zipf < 4.5),
k as (select w.doc_id, w.n, lower(regexp_replace(w.word, '[^A-Za-z]', '', 'g')) as word from w), d as (select k.doc_id, n, row_number() over (partition by k.doc_id order by n) as r from k join h on k.doc_id = h.doc_id and k.word = h.word)
select doc_id, cast(n - 1 as int) as idx, 'user' as kind from w where n <= 3 union all select doc_id, cast(n - 1 as int), 'difficult' from d where n > 3 and r <= 5000""")
def highlight_words(spark, sf):
    d = _dealt(spark, sf)
    opening = d.select("doc_id", F.regexp_extract("text", r"^\s*(?:\S+\s*){0,3}", 0).alias("text"))
    third = S.tokens_of(opening).groupBy("doc_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = S.valid_spans(third.unionByName(d.select("doc_id", F.lit(5).alias("start"), F.lit(5).alias("end"))), d)
    return S.highlight_texts(d, spans, M.difficult_words(d, _listed(spark, sf))).select("doc_id", "idx", "kind")


@query("""with t as (select text, source from documents) select source, cast(count(*) as bigint) as n, cast(sum(length(regexp_replace(text, '[^.!?]', '', 'g'))) as bigint) as ends from t group by source""")
def punctuation_by_source(spark, sf):
    d = _docs(spark, sf)
    found = search.find_regex(d, "[.!?]").groupBy("doc_id").agg(F.sum(F.size("matches")).alias("e"))
    return d.select("doc_id", "source").join(found, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("e", F.lit(0))).alias("ends"))


@query("""with b as (select p_partkey, p_partkey // 40 as doc, 1 as page, p_name as text, p_partkey % 10 = 0 as wide, case when p_partkey % 10 = 0 then 0 else p_partkey % 2 end as col, p_partkey % 40 as y from part),
w as (select *, cast(coalesce(sum(cast(wide as int)) over (partition by doc order by y desc rows between unbounded preceding and 1 preceding), 0) as bigint) as band from b),
c as (select doc, count(distinct col) as columns from b where not wide group by doc)
select w.doc, page, text, cast(row_number() over (partition by w.doc order by case when columns > 1 then band else 0 end, case when columns > 1 then wide else false end, case when columns > 1 then col else 0 end, y desc, col) as int) as position from w left join c on w.doc = c.doc""")
def reading_order(spark, sf):
    """Pages of up to forty parts in two columns, every tenth across both."""
    key, wide = F.col("p_partkey"), F.col("p_partkey") % 10 == 0
    b = table(spark, sf, "part").select(F.floor(key / 40).alias("doc"), F.lit(1).alias("page"), F.col("p_name").alias("text"), F.when(wide, 0).otherwise(key % 2 * 300).cast("double").alias("x0"), F.when(wide, 550).otherwise(key % 2 * 300 + 200).cast("double").alias("x1"), (key % 40).cast("double").alias("y1"))
    b = b.withColumns({"y0": F.col("y1") - 0.5, "page_w": F.lit(600.0)})
    return S.reading_order(b).select("doc", "page", "text", "position")


@query("""with t as (select source, unnest(string_split_regex(lang || ', #' || source, '[,\\s]+')) as tag from documents) select replace(tag, '#', '') as tag, count(*) as notes from t group by all""")
def tag_index(spark, sf):
    from folioframe.operators import vault

    d = _docs(spark, sf).withColumn("tags", T.split_tags(F.concat("lang", F.lit(", #"), "source")))
    return vault.tag_index(d)


@query(f"""with n as ({V.plain(V.NOTES)}) select doc as path, count(*) as notes, count(distinct tag) as tags from n where contains(lower(note), 'the') or contains(lower(anchor), 'the') or contains(lower(tag), 'the') group by doc""")
def notes_by_document(spark, sf):
    n = search.match_notes(V.frame(spark, sf, V.NOTES).withColumn("tags", F.array("tag")), "the")
    return n.groupBy(F.col("doc").alias("path")).agg(F.count(F.lit(1)).alias("notes"), F.countDistinct("tag").alias("tags"))