"""Tables that the given ones imply: notes, edges, a review log, listings, replicas, ticks.

Each is one SQL text that Spark and the oracle both read; ``{name}`` stands for
a given table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from folioframe.session import table

NOTES = """select conv_id as doc, conv_id * 100 + turn as id, cast(turn as int) as char_pos, substr(text, 1, 40) as anchor, substr(text, 41) as note, role as tag from {conversations}"""
EDGES = """select conv_id * 100 + turn as src, conv_id * 100 + turn - 1 as dst, 'FOLLOWS' as rel_type from {conversations} where turn > 0
union all select conv_id * 100 as src, (conv_id + 7) * 100 as dst, 'SEE_ALSO' as rel_type from {conversations} where turn = 0 and lower(substr(text, 1, 1)) < 'n'"""
REVIEW_LOG = """select user_id as card_id, cast(ts as date) as day, event_id, case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end as grade
from {events} where event_type <> 'signup'"""
LIBRARY = """select doc_id as path, concat('/lib/', source) as folder, substr(text, 1, 40) as title, lang, n_chars from {documents}"""
_PROGRESS = """select path, pos, day from (select user_id as path, cast(floor(value) as int) as pos, cast(ts as date) as day,
row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events} where event_type in (TYPES)) x where rn = 1"""
LOCAL_PROGRESS = _PROGRESS.replace("TYPES", "'click', 'view'")
REMOTE_PROGRESS = _PROGRESS.replace("TYPES", "'purchase', 'error'")
TICKS = """select user_id as reader, ts, event_id, user_id % 20 as doc, event_type <> 'error' as speaking, cast(floor(value) as int) as word_idx from {events}"""
INDEX_OLD = """select doc_id as path, n_chars as size, text from {documents} where coalesce(lang, '') <> 'de'"""
INDEX_NEW = """select doc_id as path, n_chars + case when n_chars % 9 = 0 then 1 else 0 end as size, case when n_chars % 2 = 0 then null else text end as text from {documents} where coalesce(lang, '') <> 'fr'"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the tables of a data folder."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The view's text for an engine where the tables go by their names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
