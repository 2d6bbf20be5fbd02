"""Reading sessions from ticks: gaps and islands. The streaming twin is in ``streaming.ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_sessions(ticks: DataFrame, *, gap: str = "12 hours", words_total: int | None = None) -> DataFrame:
    """Sessions of each reader: a new one begins after a gap, a pause or with another document.

    Seconds accrue between ticks while speaking; ``words_read`` is the furthest
    word, at most ``words_total``.
    """
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    order = Window.partitionBy("reader").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    same = F.lag("doc").over(order).eqNullSafe(F.col("doc")) & F.lag("speaking").over(order).eqNullSafe(F.lit(True))
    wait = F.unix_micros("ts") - F.unix_micros(before)
    #: microseconds of the gap, by Spark's own reading of the interval
    limit = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + interval {gap}) - unix_micros(timestamp'1970-01-01 00:00:00')")
    goes_on = F.coalesce(same & F.col("speaking") & (wait <= limit), F.lit(False))
    marked = ticks.withColumn("_on", goes_on).withColumn("_wait", F.when(goes_on, wait / 1e6).otherwise(0.0))
    marked = marked.withColumn("session", F.sum((~F.col("_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = (F.max("word_idx") + 1).cast("int")
    return marked.filter("speaking").groupBy("reader", "doc", "session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("_wait").alias("seconds"), F.count(F.lit(1)).alias("ticks"),
        (F.when(words.isNotNull(), F.least(words, F.lit(words_total))) if words_total else words).alias("words_read"),
    )
