import datetime as dt
import os
import time
import types

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from folioframe.operators import merge
from folioframe.operators import review as R
from folioframe.operators import sessions
from folioframe.streaming import ordered as O
from folioframe.streaming import streams as T

TICK = "reader string, ts timestamp, event_id long, doc string, speaking boolean, word_idx int"


def at(minutes, micros=0):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minutes, microseconds=micros)


def run(spark, tmp_path, batches, schema, build, mode="append"):
    """The rows that a stream over these batches gives, batch by batch."""
    source, out = tmp_path / "in", tmp_path / "out"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(source))
    keep = lambda frame, n: frame.write.mode("overwrite").parquet(f"{out}/batch={n}")
    with O.stateful(spark):
        build(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(out))


def test_sessions_out_of_order_equal_the_batch(spark, tmp_path):
    ticks = [
        ("a", at(0), 1, "x", True, 3), ("a", at(1, 7), 2, "x", True, 9), ("a", at(1, 7), 3, "x", True, None), ("a", at(2), 4, "y", True, 0), ("a", at(3), 5, "y", False, 5), ("a", at(4), 6, "y", True, 1),
        ("a", at(4 + 721), 7, "y", True, 2), ("a", at(4 + 721 + 720), 8, "y", True, 50), ("b", at(5), 9, None, True, 1), ("b", at(6), 10, None, True, 2), ("b", at(1500), 11, "x", True, None), ("a", at(1600), 12, "y", False, 0),
    ]
    end = [("", at(9000), 99, None, False, None)]
    batches = [[ticks[i] for i in (1, 5, 9, 0, 3)], [ticks[i] for i in (8, 2, 4, 6)], [ticks[i] for i in (10, 7)], [ticks[11]], end]
    want = sessions.reading_sessions(spark.createDataFrame(ticks, TICK), words_total=40)
    got = run(spark, tmp_path, batches, TICK, lambda s: O.session_stream(s, late="2 days", words_total=40)).drop("batch")
    columns = ["reader", "doc", "session", "started", "ended", "seconds", "ticks", "words_read"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())) and got.count() == 6


def test_session_comes_out_once_it_is_over_and_no_later(spark, tmp_path):
    batches = [[("a", at(0), 1, "x", True, 1)], [("b", at(700), 2, "x", True, 1)], [("b", at(800), 3, "x", True, 1)], [("b", at(5000), 4, "x", False, 1)]]
    got = {r.reader: r.batch for r in run(spark, tmp_path, batches, TICK, lambda s: O.session_stream(s, late="1 minute")).collect()}
    assert set(got) == {"a", "b"} and got["a"] < got["b"]


LOG = "card_id long, ts timestamp, event_id long, day date, grade int"


def test_reviews_out_of_order_equal_the_batch(spark, tmp_path):
    rows = [(c, at(1440 * d + 7 * c), 100 * c + d, (at(1440 * d)).date(), 1 + (c * d) % 4) for c in range(5) for d in range(0, 30, c + 1)]
    shuffled = sorted(rows, key=lambda r: (r[1].day // 8, hash((r[2] * 7919) % 101)))
    parts = [[r for r in shuffled if r[1].day // 8 == k] for k in range(4)]
    batches = [p for p in parts if p] + [[(-1, at(10**5), 0, None, None)]]
    want = {r.card_id: r.state for r in R.schedule_reviews(spark.createDataFrame(rows, LOG)).collect()}
    found = run(spark, tmp_path, batches, LOG, lambda s: T.review_stream(s, late="9 days"), "update")
    got = {r.card_id: r for r in found.groupBy("card_id").agg(F.max_by(F.struct("*"), "reps").alias("s")).select("s.*").collect()}
    names = ("stability", "difficulty", "interval", "reps", "lapses", "last_review", "next_review")
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == {k: tuple(s[n] for n in names) for k, s in want.items()}


def test_file_written_in_two_steps_is_converted_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    slow = folder / "slow [1].txt"
    slow.write_text("first ")
    watch = lambda quiet, **o: T.watch_and_convert(spark, str(folder), str(out), quiet=quiet, **o).awaitTermination()
    watch(3600)
    assert not (out / "log").exists()
    slow.write_text("first second")
    watch(3600)
    assert not (out / "log").exists()
    watch(0)
    read = lambda name: spark.read.parquet(str(out / name))
    assert [r.content for r in read("converted").collect()] == ["first second"] and read("log").count() == 1
    watch(0)
    assert read("log").count() == 1  # once
    slow.write_text("third")
    os.utime(slow, (time.time() - 60,) * 2)
    watch(5)
    assert sorted(r.content for r in read("converted").collect()) == ["first second", "third"]
    slow.write_text("fourth")
    watch(3600, give_up=0)
    assert [(r.source.rsplit("/", 1)[-1], r.error) for r in read("failed").collect()] == [("slow [1].txt", "never settled")] and read("log").count() == 3


def test_running_watch_takes_a_file_by_its_timer(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    query = T.watch_and_convert(spark, str(folder), str(out), quiet=1.5, poll="300 milliseconds", continuous=True)
    try:
        (folder / "a.txt").write_text("one")
        until = time.time() + 60
        while time.time() < until and not list((out / "log").glob("batch=*/*.parquet")):
            assert query.isActive
            time.sleep(0.3)
    finally:
        query.stop()
    assert [r.content for r in spark.read.parquet(str(out / "converted")).collect()] == ["one"]


def test_progress_is_merged_with_the_other_replica(spark, tmp_path):
    schema = "key string, ts timestamp, pos int"
    theirs = [[("a", at(5), 50), ("b", at(1), 1)], [("c", at(9), 9), ("d", at(2), 20)]]
    mine = [[("a", at(4), 4), ("a", at(4, 100), 41), ("b", at(3), 3)], [("d", at(2), 2), ("e", at(1), 7)]]

    def stream(name, batches, **options):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
            T.progress_stream(spark.readStream.schema(schema).parquet(str(tmp_path / f"{name}-in")), str(tmp_path / name), str(tmp_path / f"{name}-c"), **options).awaitTermination()

    stream("theirs", theirs)
    stream("mine", mine, replica=str(tmp_path / "theirs"))
    newest = lambda batches: spark.createDataFrame([r for b in batches for r in b], schema).groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("pos", "ts").alias("pos"))
    want = {r.key: (r.ts, r.pos) for r in merge.merge_progress(newest(mine), newest(theirs), prefer="local").collect()}
    assert {r.key: (r.ts, r.pos) for r in T.current_progress(spark, str(tmp_path / "mine")).collect()} == want and want["d"][1] == 2 and want["a"][1] == 50


class Handle:
    """A state store in memory that counts what is asked of it."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def state(self, name, _):
        outer = self

        class State:
            exists = lambda self: bool(outer.values.get(name))
            get = lambda self: outer.values[name]

            def put(self, value):
                outer.calls += 1
                outer.values[name] = value

            update = put
            clear = lambda self: self.put([])
            appendValue = lambda self, value: self.put([*outer.values.get(name, []), value])

        return State()

    getListState = getValueState = state

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


def test_readers_of_a_group_share_their_calls():
    """what the state store is asked grows with groups and micro-batches, not with readers."""
    handle, minute = Handle(), 60_000_000
    p = O.SessionProcessor(pa.string(), pa.int64(), 720 * minute, None)
    p.init(handle)
    frame = pd.DataFrame([(f"r{i}", minute * (k + 1), k, i if i % 3 else None, True, None if i % 2 else k) for i in range(1000) for k in range(3)], columns=["reader", "us", "event_id", "doc", "speaking", "word_idx"])
    list(p.handleInputRows((0,), iter([frame]), None))
    now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 3 * 60_000)
    assert not list(p.handleExpiredTimer((0,), now, None)) and max(handle.timers) == 723 * 60_000 + 1
    late = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 724 * 60_000)
    (out,) = p.handleExpiredTimer((0,), late, None)
    assert len(out) == 1000 and set(out["ticks"]) == {3} and set(out["seconds"]) == {120.0} and out["doc"].isna().sum() == 334 and out["words_read"].isna().sum() == 500
    assert not list(p.handleExpiredTimer((0,), late, None)) and handle.calls < 10
