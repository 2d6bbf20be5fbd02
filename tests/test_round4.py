"""Cases of the findings on work per row, per file and per task."""

from pathlib import Path

from folioframe.functions import numbers as N
from folioframe.operators import mining
from folioframe.plans import source_queries
from folioframe.session import table
from folioframe.sources import archives

SF = "/root/testdata/sf0.001"


def test_the_same_runs_are_read_once(monkeypatch):
    """A run is read anew only where it or what touches it differs; long ones are not kept."""
    calls, reading = [], N.reading
    monkeypatch.setattr(N, "reading", lambda *a: calls.append(a) or reading(*a))
    rows = [f"{'abc'[i % 3]} has 83% on 1987-11-29, at $7.05 or 10:47 pm." for i in range(900)]
    assert len({N.spoken(t)[1:] for t in rows}) == 1 and len(calls) < 20
    assert N.spoken("x1987 1987x 1987. 1987, .1987 (1987)") == "x1987 1987x 1987. nineteen eighty-seven, .1987 (nineteen eighty-seven)"
    long = "1,000" * 40
    assert list(N.numbers_in(long)) == list(N.numbers_in(long))


def test_small_archives_share_tasks():
    """Tasks grow with the bytes; every archive is covered once, few archives have a task each."""
    sizes = [(f"{i:05}.{'zip' if i % 2 else 'tgz' if i % 3 else 'tar'}", 200_000 + i) for i in range(5_000)]
    parts = archives.plan(sizes, 1 << 16, 64)
    assert 16 <= len(parts) <= 128
    assert max(sum(min(r.end, 205_000) - r.start for r in p.ranges) for p in parts) <= archives.RANGE_BYTES
    covered = {}
    for r in (r for p in parts for r in p.ranges):
        covered.setdefault(r.archive, []).append((r.start, r.end))
    for path, size in sizes:
        at = 0
        for start, end in sorted(covered[path]):
            assert start == at
            at = end
        assert at >= size
    assert len(archives.plan(sizes[:30], 1 << 26, 64)) == 30 and not archives.plan([], 1 << 26, 64)


def test_feeds_share_files(spark, monkeypatch):
    """Files grow with the parts, not with the feeds; every feed is read from them."""
    folders, written = [], source_queries._written
    monkeypatch.setattr(source_queries, "_written", lambda *a, **k: folders.append(written(*a, **k)) or folders[-1])
    got = source_queries.feed_items(spark, SF).collect()
    feeds = table(spark, SF, "part").filter("p_size % 5 <> 0").selectExpr("p_brand || '-' || floor(p_partkey / 1000) b").distinct().count()
    files = [f for f in Path(folders[0].removeprefix("file://")).rglob("part-*")]
    assert len({r.feed for r in got}) == feeds > 10 and len(files) <= 2, (feeds, len(files))


def test_notes_that_share_a_word_are_dealt_out(spark):
    """All notes hold the concepts' first word: they go to a stated number of tasks by the word and the note."""
    notes = spark.range(2000).selectExpr("id", "'a Brand' as anchor", "concat('Brand#', id % 5, ' tin') as note")
    concepts = spark.createDataFrame([("Brand#1", 0), ("Brand#3", 0), ("tin", 1)], "text string, first int")
    found = mining.suggest_links(concepts, notes)
    got = {r.concept: r.ids for r in found.collect()}
    assert got == {"Brand#1": list(range(1, 2000, 5)), "Brand#3": list(range(3, 2000, 5)), "tin": list(range(2000))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "_salt" in plan
