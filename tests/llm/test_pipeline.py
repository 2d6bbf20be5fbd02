from collections import Counter

import pyarrow as pa
import pytest

from folioframe.llm import best_fit, neardup, packing
from folioframe.llm import secrets as S
from folioframe.llm.packing import encoder
from folioframe.session import table
from tests_llm_helpers import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline as P
    from folioframe.session import materialize

    docs, out = table(spark, SF, "documents"), []
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), "test")
        out.append((name, before, docs))
    return out


def test_names_and_columns(spark, steps):
    assert [n for n, _, _ in steps] == ["toxicity", "near-dedup", "secrets", "mixing", "packing"]
    assert all(after.columns == table(spark, SF, "documents").columns for _, _, after in steps[:-1])


def test_toxicity_drops_what_it_predicts(spark, steps):
    from folioframe.llm import toxicity as X

    _, before, after = steps[0]
    lexicon = X.learn(before, table(spark, SF, "labels"))
    want = {r.doc_id: tuple(r) for r in before.collect() if lexicon.score(sum(h[2] for h in X.hits(X.fold(r.text), lexicon.automaton())), len(X.fold(r.text))) < X.THRESHOLD}
    assert {r.doc_id: tuple(r) for r in after.collect()} == want


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {i for i, c in brute_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_secrets_are_replaced(steps):
    _, before, after = steps[2]
    old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert set(old) == set(new)
    found = {r.doc_id: r.all_spans for r in S.scan_secrets(before).collect()}
    for i, r in new.items():
        if not found[i]:
            assert r == old[i]
            continue
        want, at = "", 0
        for s in sorted(found[i], key=lambda s: s.start):
            if s.start > at or not want:
                want += old[i].text[at : s.start] + "[secret]"
            at = max(at, s.end)
        assert r.text == want + old[i].text[at:] and r.n_chars == len(r.text)


def test_mix_repeats_rows(steps):
    _, before, after = steps[3]
    from folioframe.llm.mixing import mix_sources

    copies = {r.doc_id: r.copies for r in mix_sources(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: c for i, c in copies.items() if c})


def test_packed_tokens_are_the_texts(steps):
    _, before, after = steps[4]
    encode = encoder()
    docs = Counter(tuple([*encode(r.text or ""), 1]) for r in before.collect())
    rows = after.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(len(r.ids) == r.length for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = sum(r.length for r in rows)
    assert total == sum(len(k) * n for k, n in docs.items())


def test_run_is_the_stages(spark, steps):
    import __spark_entry__ as e

    key = lambda r: (r.doc_id, r.start, r.ids_crc32)
    assert sorted(map(key, e.queries()["pipeline"](spark, SF).collect())) == sorted(map(key, steps[-1][2].collect()))


class Step:
    """Stands for a frame, to get at the function that a step gives mapInArrow."""

    columns = ["doc_id", "text"]
    schema = None

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.run = f
        return self


@pytest.mark.parametrize("step", [lambda d: packing.piece_rows(d, with_ids=True), lambda d: best_fit.piece_rows(d, with_ids=True), neardup.set_rows])
def test_a_step_leaves_python_in_bounded_batches(spark, step):
    docs = Step()
    step(docs)
    texts = ["some words of a text " * (i % 300) for i in range(6000)]
    batch = pa.record_batch({"doc_id": range(len(texts)), "hash": range(len(texts)), "text": texts} if step is neardup.set_rows else {"doc_id": range(len(texts)), "text": texts})
    whole = [b for b in docs.run(iter([batch]))]
    assert max(b.nbytes for b in whole) < 4_000_000 and len(whole) > 5
    assert {i for b in whole for i in b.column(0).to_pylist()} == set(range(len(texts)))
