import math
import zlib

import numpy as np
import pytest

from folioframe.llm import lm as L
from folioframe.session import materialize, table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, SF, "documents").collect()]
    rows += [(1, None, None, None, 0), (1, "", "en", "s", 0), (None, "The of The", "en", "s", 0), (10**6, "the of and " * 3000, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "score"), rows


def test_base_scores_match_brute_force(docs):
    frame, rows = docs
    counts = L.token_counts([r[1] for r in rows if not held(r[0])])
    n, v = sum(counts.values()), len(counts)
    got = L.lm_scores(frame, block_tokens=50_000).collect()
    assert len(got) == len(rows)
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[3], round(r[5], 6))
    want = []
    for i, t, *_ in rows:
        tokens = [*L.words_of(t), b""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base))
    for a, b in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score <= 0 for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_states_are_distributions_and_traversal_is_the_recursion(docs, order):
    frame, rows = docs
    blocks = materialize(L.token_blocks(frame), "t")
    totals = materialize(L.word_totals(blocks), "t")
    a, n, v = L.build_automaton(blocks, totals, order=order, core_floor=2.0**-9, arc_floor=2.0**-12)
    counts = L.token_counts([r[1] for r in rows if not held(r[0])])
    assert (n, v) == (sum(counts.values()), len(counts)) and (order == 1) == (not a.arcs)
    width = len(a.core)
    rest = 1 - a.core_p.sum()
    logs = np.log10(a.core_p)

    def p(state, c):
        if not state:
            return a.core_p[c]
        arc = a.arcs.get(state * a.width + c)
        return 10 ** arc[0] if arc else 10 ** a.backoff[state] * p(a.fail[state], c)

    def unknown(state):
        return 10 ** a.backoff[state] * unknown(a.fail[state]) if state else rest

    states = sorted({k // a.width for k in a.arcs} | {s for _, s in a.arcs.values()} | {a.start})
    for s in states[:: max(1, len(states) // 60)]:
        assert abs(sum(p(s, c) for c in range(width)) + unknown(s) - 1) < 1e-6
    if order >= 3:  # states of two words are reached
        assert max(s for _, s in a.arcs.values()) > width
    numbers = list(np.random.default_rng(0).integers(-1, width, 400))
    total, state = 0.0, a.start
    for c in numbers:
        if c < 0:
            total += math.log10(unknown(state) / rest * 1e-5)
            state = 0
            continue
        total += math.log10(p(state, c))
        s = state
        while s and (s * a.width + c) not in a.arcs:
            s = a.fail[s]
        state = a.arcs[s * a.width + c][1] if s else a.next_root[c]
    assert abs(total - a.score([int(c) for c in numbers], [float(logs[c]) if c >= 0 else -5.0 for c in numbers])) < 1e-6


def test_no_training_rows_and_empty(spark):
    only = spark.createDataFrame([(i, "a b", "en", "s", 1) for i in range(200) if held(i)], DOCS)
    got = L.lm_scores(only).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got) and got
    assert L.lm_scores(only.limit(0)).count() == 0


def brute_model(rows, order):
    """(id, log10 probability) of every row, from the counts of all n-grams."""
    grams = [{} for _ in range(order + 1)]
    padded = [(i, [b"", *L.words_of(t), b""]) for i, t in rows]
    for i, w in padded:
        for k in range(1, order + 1) if not held(i) else ():
            for j in range(max(1, k - 1), len(w)):
                g = tuple(w[j - k + 1 : j + 1])
                grams[k][g] = grams[k].get(g, 0) + 1
    n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for i, w in padded:
        total = 0.0
        for j in range(1, len(w)):
            p = (grams[1].get((w[j],), 0) + 0.1) / (n + 0.1 * (v + 1))
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(w[j - k + 1 : j + 1])
                p = (grams[k].get(g, 0) + 20 * p) / (grams[k - 1].get(g[:-1], 0) + 20)
            total += math.log10(p)
        out.append((-1 if i is None else i, total))
    return sorted(out)


@pytest.mark.parametrize(("order", "block_tokens"), [(1, 50_000), (3, 50_000), (3, 1 << 20), (4, 20_000)])
def test_every_ngram_counts(docs, order, block_tokens):
    frame, rows = docs
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in L.lm_scores(frame, order=order, block_tokens=block_tokens).collect())
    for a, b in zip(got, brute_model([r[:2] for r in rows], order), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1]))


def test_rare_ngram_counts_in_a_large_corpus(spark):
    """600,000 tokens of frequent words, so that the old floors (18 and 2 tokens) would drop what occurs a few times."""
    common = "a b c d e f " * 1000
    rows = [(i, common, "en", "s", 1) for i in range(100)] + [(i, f"rare{i % 4} pair{i % 4} end", "en", "s", 1) for i in range(1000, 1020)]
    got = sorted((r.doc_id, r.score) for r in L.lm_scores(spark.createDataFrame(rows, DOCS)).collect())
    for a, b in zip(got, brute_model([r[:2] for r in rows], 3), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1]))


def test_scores_are_those_of_the_whole_automaton(docs):
    frame, rows = docs
    frame = frame.filter("doc_id between 2 and 400")  # ids that occur once
    blocks = materialize(L.token_blocks(frame), "t")
    a, n, v = L.build_automaton(blocks, materialize(L.word_totals(blocks), "t"), core_floor=0.0, arc_floor=0.0, fewest=1)
    got = {r.doc_id: r.score for r in L.lm_scores(frame).collect() if not r.held_out}
    number = {h: i for i, h in enumerate(a.core.tolist())}
    texts = {r[0]: r[1] for r in rows}
    for i, score in got.items():
        c = [*(number[L.word_hash(w)] for w in L.words_of(texts[i])), number[L.END]]
        assert abs(a.score(c, np.log10(a.core_p[c]).tolist()) - score) < 1e-6 * max(1, abs(score))
    assert len(got) > 100
