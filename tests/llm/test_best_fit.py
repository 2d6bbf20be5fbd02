import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import best_fit as B
from folioframe.llm.packing import encoder
from folioframe.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(items, most):
    """Rooms left: large items matched longest first, the others by best fit, one item at a time."""
    large, rooms = sorted((x for x in items if 3 * x > most), reverse=True), []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= most), 0)
        if b:
            large.remove(b)
        rooms.append(most - a - b)
    for s in sorted((x for x in items if 3 * x <= most), reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit)[1]] -= s
        else:
            rooms.append(most - s)
    return sorted(rooms)


def spread(made, counts):
    """(offset, length) of every item by sequence."""
    rows, found = sorted(zip(made.length, made.rank, made.each, made.sequence, made.offset, strict=True)), defaultdict(list)
    for (length, rank, each, sequence, offset), after in zip(rows, [*rows[1:], (0,) * 5], strict=False):
        for n in range((after[1] if after[0] == length else counts[length]) - rank):
            found[sequence + n // each].append((offset + n % each * length, length))
    return found


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([8, 16, 64]).flatmap(lambda most: st.tuples(st.just(most), st.lists(st.integers(1, most), max_size=80))))
def test_plan_is_best_fit_of_single_items(case):
    most, items = case
    counts = Counter(items)
    made = B.plan(counts, most)
    found = spread(made, counts)
    assert sorted(most - sum(n for _, n in v) for v in found.values()) == brute(items, most) and len(found) == made.sequences
    assert all(o == sum(n for _, n in sorted(v)[:i]) for v in found.values() for i, (o, _) in enumerate(sorted(v)))


def test_plan_does_not_grow_with_the_corpus():
    few, many = ({k: 1 + k * 7919 % 997 * n for k in range(1, 2049)} for n in (1, 10**9))
    assert len(B.plan(many).rank) < 8192 and len(B.plan(few).rank) < 8192


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (5000, [(0, 904), (904, 2048), (2952, 2048)])])
def test_only_longer_documents_are_cut(n, want):
    assert B.cuts(n) == want


def well_packed(got, most=2048):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert all(o == sum(n for _, n in v[:i]) for i, (o, _) in enumerate(v)) and sum(n for _, n in v) <= most
    assert sorted(most - sum(n for _, n in v) for v in by.values()) == brute([r.length for r in got], most)


def test_round_trip_and_edges(spark):
    rows = [(1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 9000, "en", "s", 1), (3, "same", "e", None, 1), (3, "same", "e", None, 1), (None, "x", "e", "s", 1), (4, "a <|endoftext|> b", "e", "s", 1)]
    rows += [(10 + i, "many of one length", "e", "s", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "rank")
    got = B.pack(docs, with_ids=True).collect()
    well_packed(got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    long = sorted((r for r in got if r.doc_id == 2), key=lambda r: r.piece)
    assert [i for r in long for i in r.ids] == [*encoder()("word " * 9000), 0] and [r.length for r in long[1:]] == [2048] * (len(long) - 1)
    assert [r.ids for r in got if r.doc_id == 1] == [[0], [0]] and sum(r.doc_id == 3 for r in got) == 2
    again = B.pack(docs.repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id or 0, r.piece, r.sequence_id, r.offset) for r in rows)
    assert key(again) == key(got)
    assert B.pack(docs.limit(0)).count() == 0


def test_query_packs_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs, got = table(spark, sf, "documents").select("doc_id", "text").collect(), B.op13_best_fit(spark, sf).collect()
    well_packed(got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d in docs:
        ids = [*encoder()(d.text or ""), 0]
        mine = sorted(by.pop(d.doc_id), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == [(i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(B.cuts(len(ids)))]
    assert not by
