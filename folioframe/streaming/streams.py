"""Streaming twins: hot folders, review states, progress, the index and late data."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from folioframe.operators.merge import merge_progress
from folioframe.operators.review import AGAIN, DECAY, EASY, FACTOR, HARD, LONGEST, RETENTION, WEIGHTS
from folioframe.sources.sinks import convert_corpus
from folioframe.streaming.ordered import GROUPS, InOrder, _blob, group_of, stateful


FOUND = "path string, length long, modified timestamp"


class Settling(StatefulProcessor):
    """A file is let through once its size and time have held for ``quiet`` seconds, once per version.

    The state is what was seen last, since when, and whether it was let
    through; a timer comes back for a file that nothing more is heard of. A file
    that keeps changing for ``give_up`` seconds is let through as unsettled.
    """

    def __init__(self, quiet: float, give_up: float):
        self.quiet, self.give_up = quiet, give_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "length long, modified long, since long, first long, done boolean")

    def _judge(self, key: Any, seen: tuple, now: int) -> Iterator[pd.DataFrame]:
        length, modified, since, first, done = seen
        due = max(since, modified) + int(self.quiet * 1000)
        settled = length > 0 and due <= now
        if not done and (settled or first + int(self.give_up * 1000) <= now):
            done = True
            yield pd.DataFrame({"path": [key[0]], "length": [length], "modified": [pd.Timestamp(modified, unit="ms")], "settled": [settled]})
        elif not done:
            self.handle.registerTimer(max(min(due if length > 0 else now + int(self.give_up * 1000), first + int(self.give_up * 1000)), now) + 1)
        self.seen.update((length, modified, since, first, done))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        latest = pd.concat(list(rows)).sort_values("modified").iloc[-1]
        length, modified = int(latest["length"]), int(pd.Timestamp(latest["modified"]).value // 1_000_000)
        seen = tuple(self.seen.get()) if self.seen.exists() else None
        if seen is None or seen[4] and seen[:2] != (length, modified):
            seen = (length, modified, min(now, modified), now, False)
        elif seen[:2] != (length, modified):
            seen = (length, modified, now, seen[3], False)
        yield from self._judge(key, seen, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._judge(key, tuple(self.seen.get()), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def _listing(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """FOUND rows of the files under ``folder``; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(~F.contains("path", F.lit(f"{out.split(':', 1)[-1]}/"))).select("path", "length", F.col("modificationTime").alias("modified"))


def watch_and_convert(spark: SparkSession, folder: str, out: str, fmt: str = "text", *, render: Callable | None = None, quiet: float = 2.0, give_up: float = 600.0, poll: str = "1 second", continuous: bool = False) -> StreamingQuery:
    """Convert files as they settle: each version once, results to ``out/converted``, failures to ``out/failed``, all to ``out/log``.

    Each poll lists the folder; what is not in the log yet is an observation
    for a stream that holds a file until it has kept its size and time for
    ``quiet`` seconds (a file last written before that is settled at first
    sight). A file that is still being written is neither converted nor logged;
    later polls, in this run or the next, come back to it. After ``give_up``
    seconds without settling it fails. A file that changes after it was
    converted is a new version; one without a byte is passed over. Without
    ``continuous`` there is one poll.
    The driver holds the names of the files that settle in one poll, as Spark's
    own file source does. Needs the RocksDB state store; the checkpoint keeps
    the states over restarts.
    """
    seen, log = f"{out}/_seen", f"{out}/log"

    def observe() -> None:
        found, done = _listing(spark, folder, out), _table_or_none(spark, log)
        if done is not None:
            found = found.join(done.select(F.col("source").alias("path"), "length", "modified"), ["path", "length", "modified"], "left_anti")
        found.write.mode("append").parquet(seen)

    def batch(frame: DataFrame, n: int) -> None:
        settled = frame.persist()
        try:
            if settled.isEmpty():
                return
            now = _listing(spark, folder, out).join(settled.select("path", "length", "modified", "settled"), ["path", "length", "modified"], "left_semi")
            names = [re.sub(r"([\\\\*?\[\]{}])", r"\\\1", r["path"]) for r in now.filter("length > 0").select("path").collect()]
            content = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(names).select("path", "content") if names else spark.createDataFrame([], "path string, content binary")
            text = F.when(F.col("settled"), F.try_validate_utf8("content"))
            rows = settled.join(content, "path", "left").select("path", "length", "modified", "settled", text.alias("text"))
            error = F.when(~F.col("settled"), F.lit("never settled"))
            results = convert_corpus(rows.select("path", "text"), fmt, render).join(rows.select(F.col("path").alias("source"), "length", "modified", error.alias("_error")), "source").withColumn("error", F.coalesce("_error", "error")).withColumn("logged_at", F.current_timestamp()).persist()
            try:
                results.filter("ok").select("source", "output", "content").write.mode("overwrite").parquet(f"{out}/converted/batch={n}")
                results.filter("not ok").select("source", "error").write.mode("overwrite").parquet(f"{out}/failed/batch={n}")
                results.select("source", "length", "modified", "output", "ok", "error", "logged_at").write.mode("overwrite").parquet(f"{log}/batch={n}")
            finally:
                results.unpersist()
        finally:
            settled.unpersist()
            if continuous:
                observe()

    observe()
    observed = spark.readStream.schema(FOUND).parquet(seen)
    files = observed.groupBy("path").transformWithStateInPandas(Settling(quiet, give_up), f"{FOUND}, settled boolean", "Append", "ProcessingTime")
    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/_checkpoint")
    with stateful(spark, idle_batches=continuous):
        return (writer.trigger(processingTime=poll) if continuous else writer.trigger(availableNow=True)).start()


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that some run has written, or nothing if none has."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


# ---- review states


def _bounded(d: float) -> float:
    return min(max(d, 1.0), 10.0)


def fold_review(state: tuple | None, day: dt.date, grade: int, w: tuple[float, ...] = WEIGHTS, retention: float = RETENTION) -> tuple:
    """One review of a card's state (stability, difficulty, interval, reps, lapses, last, next), as the batch fold does it."""
    first = lambda g: _bounded(w[4] - math.exp(w[5] * (g - 1)) + 1.0)
    reps, lapses = (state[3], state[4]) if state else (0, 0)
    if state is None or reps <= 0 or state[0] <= 0:
        s, d = max(w[grade - 1], 0.1), first(grade)
    else:
        s0, d0 = state[0], state[1]
        r = (1.0 + FACTOR * max((day - state[5]).days, 0) / s0) ** DECAY
        d = _bounded(w[7] * first(EASY) + (1 - w[7]) * (d0 - w[6] * (grade - 3) * ((10.0 - d0) / 9.0)))
        if grade == AGAIN:
            s = max(min(w[11] * d0 ** -w[12] * ((s0 + 1) ** w[13] - 1) * math.exp(w[14] * (1 - r)), s0), 0.1)
        else:
            bonus = (w[15] if grade == HARD else 1.0) * (w[16] if grade == EASY else 1.0)
            s = s0 * (math.exp(w[8]) * (11.0 - d0) * s0 ** -w[9] * (math.exp(w[10] * (1 - r)) - 1) * bonus + 1)
    s = round(s, 4)  # as it is kept
    interval = 1 if grade == AGAIN else int(min(max(round(s / FACTOR * (retention ** (1 / DECAY) - 1)), 1), LONGEST))
    return s, round(d, 4), interval, reps + 1, lapses + (grade == AGAIN), day, day + dt.timedelta(days=interval)


STATE = "stability double, difficulty double, interval int, reps int, lapses int, last_review date, next_review date"


class ReviewProcessor(InOrder):
    """Cards' states, updated with their reviews as the watermark passes these reviews' days.

    A group of cards is one key; its states are a table of one row per card.
    """

    CARDS = pa.schema([("card_id", pa.int64()), ("stability", pa.float64()), ("difficulty", pa.float64()), ("interval", pa.int32()), ("reps", pa.int32()), ("lapses", pa.int32()), ("last_review", pa.date32()), ("next_review", pa.date32())])
    row = pa.schema([("card_id", pa.int64()), ("us", pa.int64()), ("event_id", pa.int64()), ("day", pa.date32()), ("grade", pa.int32())])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ready, rest = self.passed(timerValues.getCurrentWatermarkInMs() * 1000)
        if len(rest):
            self.wake(pc.min(rest["us"]).as_py())
        graded = ready.filter(pc.is_valid(ready["grade"])).sort_by([(c, "ascending") for c in ("card_id", "day", "event_id", "grade")])
        if not len(graded):
            return
        columns = lambda rows, *names: zip(*(rows[c].to_pylist() for c in names), strict=True)
        states = {card: state for card, *state in columns(self.known(self.CARDS), *self.CARDS.names)}
        found = {}
        for card, reviews in groupby(columns(graded, "card_id", "day", "grade"), itemgetter(0)):
            state = states.get(card)
            for _, day, grade in reviews:
                state = fold_review(state, day, grade)
            found[card] = state
        self.last.update((_blob(self.cards({**states, **found})),))
        yield self.cards(found).to_pandas()

    def cards(self, states: dict) -> pa.Table:
        rows = zip(*((card, *state) for card, state in states.items()), strict=True)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, self.CARDS, strict=True)], schema=self.CARDS)


def review_stream(log: DataFrame, *, late: str = "1 day", card: str = "card_id", groups: int = GROUPS) -> DataFrame:
    """Card states updated per day of reviews, whatever order the reviews come in; needs the RocksDB state store.

    A card's reviews wait until the watermark, ``late`` behind the newest ``ts``,
    has passed them and their day, and are then folded in the order of the batch
    schedule (day, event, grade), so the states equal it. Reviews later than
    that are dropped; a row without a grade moves the watermark and nothing else.
    Cards share the states of ``groups`` groups; a task has a group's held reviews
    in memory.
    """
    rows = log.withWatermark("ts", late).withColumn("card_id", F.col(card).cast("long")).withColumn("day", F.col("day").cast("date"))
    until = F.greatest(F.unix_micros("ts"), F.unix_micros(F.date_add("day", 1).cast("timestamp")))
    rows = rows.select(group_of("card_id", groups), "card_id", "ts", until.alias("us"), F.col("event_id").cast("long").alias("event_id"), "day", F.col("grade").cast("int").alias("grade"))
    return rows.groupBy("group").transformWithStateInPandas(ReviewProcessor(), f"card_id long, {STATE}", "Update", "EventTime")


# ---- progress, index, late rows


def latest_progress(updates: DataFrame, *, window: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Progress updates of one key inside a window become the latest of them."""
    stream = updates.withWatermark("ts", late) if updates.isStreaming else updates
    values = [c for c in updates.columns if c not in ("key", "ts")]
    found = stream.groupBy("key", F.window("ts", window)).agg(F.max_by(F.struct("ts", *values), "ts").alias("v"))
    return found.select("key", "v.*")


#: Micro-batches of an era; the first of an era begins with all that is current.
ERA = 16


def _keep_deltas(changes: DataFrame, path: str, checkpoint: str, order: str, of_batch: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Writes what each micro-batch changes as a delta under ``path``.

    A batch that runs twice replaces its own delta. Every ``ERA`` batches the
    current rows are written once, so that readers see the deltas of one era.
    """

    def batch(frame: DataFrame, n: int) -> None:
        era = n // ERA
        if era and n % ERA == 0:
            current(frame.sparkSession, path, order, era - 1).write.mode("overwrite").parquet(f"{path}/era={era}/delta={n - 1}")
        of_batch(frame).write.mode("overwrite").parquet(f"{path}/era={era}/delta={n}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, order: str, era: int | None = None, key: str | None = None) -> DataFrame:
    """The last row of each key (the first column) by ``order`` over the deltas of an era, the newest without one."""
    found = spark.read.parquet(path)
    if era is None:
        era = found.agg(F.max("era")).first()[0]
    found = found.filter(F.col("era") == era).drop("era", "delta")
    key = key or found.columns[0]
    values = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(key, "_v.*")


def progress_stream(updates: DataFrame, path: str, checkpoint: str, *, replica: str | None = None, window: str = "500 milliseconds") -> StreamingQuery:
    """Progress updates (``key``, ``ts``, values) as deltas under ``path``; the newest of a key counts, late or not.

    Updates of a key inside one ``window`` of a micro-batch are coalesced. With
    ``replica``, the path of another stream's deltas, each micro-batch is merged
    with what that replica holds by then and this one doesn't know yet: the
    newer row wins, this one's where both are equally new.
    """

    def newest(frame: DataFrame) -> DataFrame:
        rows = latest_progress(frame.withColumn("ts", F.col("ts").cast("timestamp")), window=window)
        values = [c for c in rows.columns if c != "key"]
        mine = rows.groupBy("key").agg(F.max_by(F.struct(*values), "ts").alias("_v")).select("key", "_v.*")
        theirs = _table_or_none(frame.sparkSession, replica) if replica else None
        if theirs is None:
            return mine
        theirs = current(frame.sparkSession, replica, "ts").select("key", *values)
        own = _table_or_none(frame.sparkSession, path)
        if own is not None:
            known = current(frame.sparkSession, path, "ts").select(F.col("key").alias("_k"), F.col("ts").alias("_ts"))
            theirs = theirs.join(known, F.col("key") == F.col("_k"), "left").filter("_ts is null or ts > _ts").drop("_k", "_ts")
        return merge_progress(mine, theirs, prefer="local").drop("resolution")

    return _keep_deltas(updates, path, checkpoint, "ts", newest)


def current_progress(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path, "ts")


def index_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed files (``path``, ``mark``, ``size``, ``text``) as deltas of an index; ``mark`` orders a file's changes.

    A change whose extraction failed (null text) leaves the file's row as it was.
    """
    last = lambda f: f.filter("text is not null").groupBy("path").agg(F.max_by(F.struct("mark", "size", "text"), "mark").alias("_v")).select("path", "_v.*")
    return _keep_deltas(files, path, checkpoint, "mark", last)


def current_index(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path, "mark")


def split_late(rows: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newer rows, late rows): a row older than what its key already holds, or without a time, is late."""
    known = accepted.select(F.col("key").alias("_k"), F.col("ts").alias("_seen"))
    joined = rows.join(known, rows["key"] == F.col("_k"), "left")
    late = F.col("ts").isNull() | F.coalesce(F.col("ts") < F.col("_seen"), F.lit(False))
    return joined.filter(~late).select(*rows.columns), joined.filter(late).select(*rows.columns)
