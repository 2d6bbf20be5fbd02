"""Queries on stateful streams: rows out of order, files that are still being written, two replicas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.plans import library_queries
from folioframe.plans import views as V
from folioframe.session import shared_folder, table
from folioframe.streaming import ordered, streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Rows arrive up to so many days after their time, in so many files.
JITTER, PARTS, LATE = 2, 5, "9 days"
#: Rows of one of these files at most, about; a micro-batch has as many files as that takes.
FILE_ROWS = 400_000
#: Ids whose documents of one source share a hot file.
HOT_RUN = 6_000


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files, each row up to ``JITTER`` days late, and at last one row that moves the watermark on.

    Rows come in ``PARTS`` parts of about the same time each; all parts have as many files, written side by side.
    """
    folder, day = _folder(spark, "shuffled"), 86_400_000_000
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.withColumn("_at", F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(JITTER * day)))
    low, high, rows = late.agg(F.min("_at"), F.max("_at"), F.count(F.lit(1))).first()
    width, files = (high - low) // PARTS + 1, -(-rows // (PARTS * FILE_ROWS))
    for n in range(PARTS):  # one after the other, as the stream takes files by their age
        part = late.filter(F.floor((F.col("_at") - low) / width) == n).drop("_at")
        part.repartition(files).sortWithinPartitions(F.xxhash64("event_id", "ts")).write.mode("append").parquet(folder)
        for _ in range(files * (n + 1) - len(spark.read.parquet(folder).inputFiles())):  # a part of few rows has empty files, or a micro-batch would go on into the next
            events.limit(0).coalesce(1).write.mode("append").parquet(folder)
    last = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in events.dtypes)).withColumns({"ts": F.timestamp_micros(F.lit(high + 400 * day)), "user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long")})
    last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


@query(library_queries.ORACLE_SQL["reading_sessions"])
def session_stream(spark, sf):
    """The batch sessions, from ticks that come out of order."""
    ticks = _out_of_order(spark, sf).selectExpr("user_id as reader", "ts", "event_id", "user_id % 20 as doc", "coalesce(event_type <> 'error', false) as speaking", "cast(floor(value) as int) as word_idx")
    out = _folder(spark, "sessions")
    with ordered.stateful(spark):
        ordered.session_stream(ticks, late=LATE).writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/_c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/t").withColumn("seconds", F.round("seconds", 3))


@query(library_queries.ORACLE_SQL["schedule_reviews"])
def review_stream(spark, sf):
    """The batch schedule, from reviews that come out of order."""
    log = _out_of_order(spark, sf).filter("event_type <> 'signup' or user_id = -1")
    log = log.selectExpr("user_id as card_id", "ts", "cast(ts as date) as day", "event_id", "case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else if(event_type is null, null, 4) end as grade")
    out = _folder(spark, "reviews")

    def keep(frame: DataFrame, n: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/t/batch={n}")

    with ordered.stateful(spark):
        streams.review_stream(log, late=LATE).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/_c").trigger(availableNow=True).start().awaitTermination()
    days = {c: F.col(c).cast("string") for c in ("last_review", "next_review")}
    states = spark.read.parquet(f"{out}/t").drop("batch")
    values = [c for c in states.columns if c != "card_id"]
    last = states.groupBy("card_id").agg(F.max_by(F.struct(*values), "reps").alias("_v")).select("card_id", "_v.*")
    return last.withColumns({"stability": F.round("stability", 3), "difficulty": F.round("difficulty", 3), **days})


@query("""with p as (select user_id as key, ts, event_id, cast(floor(value) as int) as pos, event_type in ('purchase', 'error') as remote from events),
n as (select *, row_number() over (partition by key, remote order by ts desc, event_id desc) as r from p),
a as (select * from n where r = 1 and not remote), b as (select * from n where r = 1 and remote)
select coalesce(a.key, b.key) as key, case when a.key is null or b.ts > a.ts then b.pos else a.pos end as pos from a full join b on a.key = b.key""")
def progress_with_replica(spark, sf):
    """Two replicas' updates as two streams; the second is merged with what the first holds."""
    out, events = _folder(spark, "replicas"), _out_of_order(spark, sf).filter("user_id <> -1")
    updates = events.selectExpr("user_id as key", "ts", "cast(floor(value) as int) as pos", "event_type")
    remote, local = f"{out}/remote", f"{out}/local"
    streams.progress_stream(updates.filter("event_type in ('purchase', 'error')").drop("event_type"), remote, f"{out}/_r").awaitTermination()
    streams.progress_stream(updates.filter("event_type not in ('purchase', 'error')").drop("event_type"), local, f"{out}/_l", replica=remote).awaitTermination()
    return streams.current_progress(spark, local).select("key", "pos")


@query("""select coalesce(source, '') as source, cast(count(*) as bigint) as lines, cast(1 as bigint) as versions from documents where text is not null group by 1""")
def hot_folder(spark, sf):
    """Files of a source, written in two steps: each is converted once, with the lines of both.

    A source has a file per ``HOT_RUN`` ids, so that the files' number grows with
    the table, not their size.
    """
    folder, out = _folder(spark, "hot"), _folder(spark, "converted")
    docs = table(spark, sf, "documents").filter("text is not null").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"), F.concat_ws("-", F.concat(F.lit("s"), F.coalesce("source", F.lit(""))), F.floor(F.col("doc_id") / HOT_RUN)).alias("source"), "doc_id")
    context = spark.sparkContext
    at = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(at(folder))

    def write(rows: DataFrame) -> None:
        """Every source's part file under the source's name, over what was there."""
        parts = _folder(spark, "parts")
        rows.select("value", "source").repartition("source").write.partitionBy("source").text(parts)
        for found in fs.listStatus(at(parts)):
            if found.isDirectory():
                target = at(f"{folder}/{found.getPath().getName()}.txt")
                fs.delete(target, False)
                fs.rename(next(f.getPath() for f in fs.listStatus(found.getPath()) if f.getPath().getName().startswith("part-")), target)

    write(docs.filter("doc_id % 2 = 0"))
    streams.watch_and_convert(spark, folder, out, quiet=86_400.0, give_up=1e6).awaitTermination()
    write(docs)
    streams.watch_and_convert(spark, folder, out, quiet=86_400.0, give_up=1e6).awaitTermination()
    streams.watch_and_convert(spark, folder, out, quiet=0.0, give_up=1e6).awaitTermination()
    found = spark.read.parquet(f"{out}/converted")
    lines = F.regexp_count("content", F.lit("\n")).cast("long")
    converted = found.groupBy("source").agg(F.max(lines).alias("lines"), F.count(F.lit(1)).alias("versions"))
    name = F.url_decode(F.url_decode(F.regexp_extract("source", r"source=s([^/]*)-[0-9]+\.txt$", 1)))
    return converted.groupBy(name.alias("source")).agg(F.sum("lines").alias("lines"), F.max("versions").alias("versions"))
