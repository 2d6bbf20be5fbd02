import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioframe.llm import mixing as M
from folioframe.llm import packing as P
from folioframe.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_ids_equal_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.encoder()
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    texts += ["", " ", "\n\n  x", "<|endoftext|> a<|endoftext|>", "don't I'LL 12345 é́ \U0001f600‍\U0001f469", "\x00\x1f 　", "a" * 3000, "  \t \r\n ", "‮﻿abc"]
    for a, b in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast(a) == b.ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "x" + " " * 1_000_000 + "y", "ab " + " \n\t" * 300_000, "a" * 1_000_000, "\u3000" * 1_000_000])
def test_long_runs_get_the_same_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_packing_stage_takes_long_runs(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, " " * 1_000_000, "en", "s", 1), (2, "x", "en", "s", 1)], DOCS)
    got = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 1_000_001


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000, 4096])
def test_pieces_are_powers_of_two(n):
    got = P.pieces(n)
    assert sum(x for _, x in got) == n and [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]
    assert all(x & (x - 1) == 0 and x <= 2048 for _, x in got)


def test_pack_round_trip(spark):
    rows = [(1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 9000, "en", "s", 1), (3, "same", "e", None, 1), (3, "same", "e", None, 1), (None, "x", "e", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "start")
    got = P.pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    long = sorted((r for r in got if r.doc_id == 2), key=lambda r: r.start)
    assert [i for r in long for i in r.ids] == [*P.encoder()("word " * 9000), 1] and long[0].doc_tokens == sum(r.length for r in long)
    assert [r.ids for r in got if r.doc_id == 1] == [[1], [1]]
    assert P.pack(docs.limit(0)).count() == 0
    again = {(r.doc_id, r.start, r.ids_crc32, r.sequence_id) for r in P.pack(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.start, r.ids_crc32, r.sequence_id) for r in got}


def test_mix_meets_targets(spark):
    got = M.op1_mix_sources(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "source"), "doc_id").collect()
    taken, target, most = defaultdict(int), {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source], most[r.source] = r.target, max(r.size, most.get(r.source, 0))
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1e-3
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + most[s]


def test_mix_water_filling_and_awkward_rows(spark):
    w = lambda n: "w " * n
    rows = [(1, w(10), "x", "b", 1), (2, w(1000), "x", "c", 1), (3, w(1), "x", None, 1), (4, None, "x", "a", 1), (5, w(7), "x", "", 1), (5, w(7), "x", "", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "target")
    got = {(r.doc_id, r.source_size): r.target for r in M.mix_sources(docs, keep=["doc_id", "target"]).collect()}
    # sources in order: "", a, b, c, null with weights 5, 2, 1, 5, 2; all words 1025; "" is capped at 42, a at 0, b at 30, null at 3
    assert got == {(5, 14): 42.0, (4, 0): 0.0, (1, 10): 30.0, (3, 1): 3.0, (2, 1000): 950.0}
    assert M.mixed_rows(docs).columns == docs.columns and M.mixed_rows(docs.limit(0)).count() == 0
    copies = [r.doc_id for r in M.mixed_rows(docs).collect()]
    assert copies.count(5) == 6 and copies.count(1) == 3 and copies.count(3) == 3 and copies.count(2) in (0, 1)
