"""Stateful operators over rows that may come out of order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@contextmanager
def stateful(spark: SparkSession, *, idle_batches: bool = True) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as list states and timers need.

    A stream with processing-time timers has another batch to run as long as it
    lives; without ``idle_batches`` it ends with the data that is there.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Groups that keys are dealt over; the keys of a group share a state.
GROUPS = 256


def _blob(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _table(blob: Any) -> pa.Table:
    return pa.ipc.open_stream(bytes(blob)).read_all()


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value; nulls are one value."""
    return values.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


class InOrder(StatefulProcessor):
    """Holds a group's rows until the watermark has passed them.

    They are held as Arrow tables of the schema ``row``, one per micro-batch, so
    that the calls to the state store grow with groups and micro-batches, not with
    keys. A column ``us`` has the time, in microseconds, that the watermark must
    pass; a timer stands at the earliest.
    """

    row: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.last = handle.getValueState("last", "states binary")

    def wake(self, us: int) -> None:
        """A timer once the watermark is past ``us``."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables(pa.Table.from_pandas(frame[self.row.names], self.row, preserve_index=False) for frame in rows)
        self.held.appendValue((_blob(new),))
        self.wake(pc.min(new["us"]).as_py())
        return iter(())

    def passed(self, watermark_us: int) -> tuple[pa.Table, pa.Table]:
        """(rows that the watermark has passed, rows that are held on)."""
        held = pa.concat_tables([self.row.empty_table(), *(_table(r[0]) for r in (self.held.get() if self.held.exists() else ()))])
        passed = held["us"].to_numpy() <= watermark_us
        ready, rest = held.filter(pa.array(passed)), held.filter(pa.array(~passed))
        if len(ready) and len(rest):
            self.held.put([(_blob(rest),)])
        elif len(ready):
            self.held.clear()
        return ready, rest

    def known(self, schema: pa.Schema) -> pa.Table:
        """What the group keeps of its keys."""
        return _table(self.last.get()[0]) if self.last.exists() else schema.empty_table()

    def close(self) -> None:
        pass


class SessionProcessor(InOrder):
    """Readers' sessions as state machines; one comes out when the next one begins or ``gap`` has passed without a tick.

    Counts and measures as the batch operator does: a tick goes on with the
    session if the tick before was speaking in the same document and no longer
    ago than the gap, else it has the next number.

    A group of readers is one key; its last sessions are a table of one row per
    reader. A step over all ticks of a group is done by arrays. A timer stands at
    the earliest tick or end.
    """

    SCHEMA = "doc {doc}, session long, started timestamp, ended timestamp, seconds double, ticks long, words_read int"

    def __init__(self, reader: pa.DataType, doc: pa.DataType, gap_us: int, words_total: int | None):
        self.gap_us, self.words_total = gap_us, words_total
        self.row = pa.schema([("reader", reader), ("us", pa.int64()), ("event_id", pa.int64()), ("doc", doc), ("speaking", pa.bool_()), ("word_idx", pa.int32())])
        self.session = pa.schema([("reader", reader), ("doc", doc), ("speaking", pa.bool_()), ("last", pa.int64()), ("session", pa.int64()), ("started", pa.int64()), ("seconds", pa.int64()), ("ticks", pa.int64()), ("word", pa.int32()), ("running", pa.bool_())])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = self.passed(watermark)
        over, last = self.sessions(self.known(self.session), ready, watermark)
        self.last.update((_blob(last),))
        ends = last.filter(last["running"])["last"].to_numpy() + self.gap_us
        if len(rest) or len(ends):
            self.wake(int(min(x.min() for x in (rest["us"].to_numpy(), ends) if len(x))))
        if len(over):
            yield over

    def sessions(self, known: pa.Table, ticks: pa.Table, watermark_us: int) -> tuple[pd.DataFrame, pa.Table]:
        """(sessions that are over, the last one of each reader) after ``ticks``; a reader's known session stands before them as one tick."""
        both = lambda name, other, fill=None: np.concatenate([(t[c] if fill is None else t[c].fill_null(fill)).to_numpy() for t, c in ((known, name), (ticks, other))])
        readers, docs = (pa.chunked_array([*known[c].chunks, *ticks[c].chunks], self.row.field(c).type) for c in ("reader", "doc"))
        if not len(readers):
            return pd.DataFrame(), known
        old = len(known)
        reader, doc, us = _codes(readers), _codes(docs), both("last", "us")
        new = np.arange(len(us)) >= old
        event = np.concatenate([np.zeros(old, np.int64), ticks["event_id"].fill_null(np.iinfo(np.int64).min).to_numpy()])
        order = np.lexsort((event, us, new, reader))
        reader, doc, us, new = reader[order], doc[order], us[order], new[order]
        speaking = both("speaking", "speaking", False)[order].astype(bool)
        none = np.iinfo(np.int64).min
        word = np.concatenate([t[c].cast(pa.int64()).fill_null(none).to_numpy() for t, c in ((known, "word"), (ticks, "word_idx"))])[order]
        of_known = lambda c, other: np.where(new, other, np.concatenate([known[c].to_numpy(), np.zeros(len(ticks), np.int64)])[order])

        first = np.concatenate([[True], reader[1:] != reader[:-1]])
        wait = np.diff(us, prepend=us[0])
        goes_on = ~first & np.roll(speaking, 1) & speaking & (doc == np.roll(doc, 1)) & (wait <= self.gap_us)
        at = np.flatnonzero(~goes_on)
        ends = np.append(at[1:], len(us))
        leads = np.flatnonzero(first[at])  # the first session of each reader
        number = np.arange(len(at)) + np.repeat(of_known("session", 1)[at][leads] - leads, np.diff(np.append(leads, len(at))))
        alone = ~new[at] & (ends - at == 1)
        running = np.where(alone, of_known("running", 0)[at].astype(bool), speaking[at])
        started, ended = of_known("started", us)[at], us[ends - 1]
        seconds, count = np.add.reduceat(of_known("seconds", np.where(goes_on, wait, 0)), at), np.add.reduceat(of_known("ticks", 1), at)
        furthest = np.maximum.reduceat(word, at)
        newest = np.append(first[at][1:], True)
        over = running & (~newest | (ended + self.gap_us < watermark_us))

        who, what = readers.take(pa.array(order[at])), docs.take(pa.array(order[at]))
        words = furthest if self.words_total is None else np.minimum(furthest, self.words_total - 1)
        out = pa.table({"reader": who, "doc": what, "session": number, "seconds": seconds / 1e6, "ticks": count, "words_read": pa.array(np.where(furthest == none, 0, words + 1), pa.int32(), mask=furthest == none)}).filter(pa.array(over)).to_pandas(integer_object_nulls=True)
        for name, times in (("started", started), ("ended", ended)):
            out[name] = pd.to_datetime(times[over], unit="us")
        columns = [who, what, speaking[at], ended, number, started, seconds, count, pa.array(np.where(furthest == none, 0, furthest), pa.int32(), mask=furthest == none), running & ~over]
        last = pa.table(dict(zip(self.session.names, columns, strict=True)), self.session).filter(pa.array(newest))
        return out[["reader", *(c.split()[0] for c in self.SCHEMA.split(", "))]], last


def group_of(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("group")


def session_stream(ticks: DataFrame, *, gap: str = "12 hours", late: str = "1 day", words_total: int | None = None, groups: int = GROUPS) -> DataFrame:
    """The sessions of ``reading_sessions`` from a stream of ticks (``reader``, ``ts``, ``event_id``, ``doc``, ``speaking``, ``word_idx``), each once, when it is over.

    Ticks may come up to ``late`` out of order; later ones are dropped. A reader
    keeps one row of state between sessions, in the state of one of ``groups``
    groups; a task has a group's held ticks in memory. Needs the RocksDB state
    store (``stateful``).
    """
    types = dict(ticks.dtypes)
    processor = SessionProcessor(*(to_arrow_type(ticks.schema[c].dataType) for c in ("reader", "doc")), pd.Timedelta(gap) // pd.Timedelta("1us"), words_total)
    schema = f"reader {types['reader']}, {SessionProcessor.SCHEMA.format(doc=types['doc'])}"
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(group_of("reader", groups), "reader", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "doc", "speaking", F.col("word_idx").cast("int").alias("word_idx"))
    return rows.groupBy("group").transformWithStateInPandas(processor, schema, "Append", "EventTime")
