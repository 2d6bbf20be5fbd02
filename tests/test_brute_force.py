"""Queries that SQL can't express, against plain Python over the smallest tables."""

import math
import re
from collections import Counter

import pytest

from folioframe.functions.text import SENTENCE_GAP
from folioframe.operators import mining as M
from folioframe.plans import slate
from folioframe.session import table

SF = "/root/testdata/sf0.001"
GAP = re.compile(SENTENCE_GAP, re.A)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect() if r.text is not None}


def spans(text):
    """(start, end) of the trimmed sentences."""
    out, at = [], 0
    for m in [*GAP.finditer(text), None]:
        stop = m.start() if m else len(text)
        piece = text[at:stop]
        core = piece.strip(" \t\n\x0b\x0c\r")
        if core:
            begin = at + piece.index(core)
            out.append((begin, begin + len(core)))
        at = m.end() if m else stop
    return out


def test_sentence_spans_and_timing(spark, texts):
    got = {(r.doc_id, r.n): (r.start, r.end, r.sentence) for r in slate.QUERIES["sentence_spans"](spark, SF).collect()}
    want = {(i, n): (s, e, t[s:e]) for i, t in texts.items() for n, (s, e) in enumerate(spans(t))}
    assert got == want
    timed = {(r.doc_id, r.n): (r.start_s, r.end_s) for r in slate.QUERIES["sentence_timing"](spark, SF).collect()}
    for i, t in texts.items():
        sizes = [e - s + 1 for s, e in spans(t)]
        for n in range(len(sizes)):
            a, b = timed[i, n]
            assert math.isclose(a, 60 * sum(sizes[:n]) / sum(sizes), abs_tol=1e-9) and math.isclose(b, 60 * sum(sizes[: n + 1]) / sum(sizes), abs_tol=1e-9)


def test_cues(spark, texts):
    rows = slate.QUERIES["pack_cues"](spark, SF).collect()
    cues = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.n)):
        cues.setdefault(r.doc_id, []).append(r.cue)
    for i, t in texts.items():
        want, fresh = [], True
        for n, piece in enumerate(GAP.split(t)):
            for j, w in enumerate(re.findall(r"\S+", piece)):
                opens = n > 0 and j == 0 and not re.match(r"\s", piece)
                if fresh or opens or len(want[-1].split(" ")) >= 12 or len(want[-1]) + 1 + len(w) + 1 > 90:
                    want.append(w)
                    fresh = False
                else:
                    want[-1] += " " + w
        assert cues.get(i, []) == want


def concepts(text):
    """Names that open no sentence, and the terms of the medical domain."""
    out = []
    for m in re.finditer(M.CAP_PHRASE, text):
        before = text[: m.start()].rstrip(" \t")
        if before and before[-1] not in ".!?\n":
            out.append((m.start(), m.end(), "CONCEPT", m[0]))
    for pattern, label in M.DOMAINS["medical"]:
        out += [(m.start(), m.end(), label, m[0]) for m in re.finditer(pattern, text)]
    return sorted(out)


def test_concepts(spark, texts):
    got = {}
    for r in slate.QUERIES["concept_spans"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.label, r.text))
    assert {i: sorted(v) for i, v in got.items()} == {i: concepts(t) for i, t in texts.items() if concepts(t)}
    distinct = {(r.doc_id, r.label, r.text): (r["first"], r["count"]) for r in slate.QUERIES["distinct_concepts"](spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        for s, _, label, term in concepts(t):
            first, n = want.get((i, label, term), (s, 0))
            want[i, label, term] = (min(first, s), n + 1)
    assert distinct == want


def test_cards(spark, texts):
    zipf = {r.word: r.zipf for r in M.token_frequencies(table(spark, SF, "documents")).collect()}
    got = {(r.doc_id, r.n): list(r.terms) for r in slate.QUERIES["cloze_cards"](spark, SF).collect()}
    checked = 0
    for i, t in texts.items():
        for n, (s, e) in enumerate(spans(t)):
            sentence = t[s:e]
            found = []
            for name in re.findall(M.PROPER.removeprefix("(?U)"), sentence):
                first = re.split(r"\s+", name)[0]
                found.append(re.sub(r"^\S+\s*", "", name) if first.lower() in M.OPENERS else name)
            found += re.findall(M.NUMBER, sentence)
            facts = sorted({x.lower(): x for x in reversed(found) if len(x) > 1}.values(), key=lambda x: (sentence.find(x), x))[:3]
            rare = []
            for w in dict.fromkeys(re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", sentence)):
                if len(w) >= 4 and 0 < zipf.get(w.lower(), 0) < 4.5:
                    rare.append((zipf[w.lower()], len(rare), w))
            for _, _, w in sorted(rare):
                if len(facts) < 3 and w.lower() not in {x.lower() for x in facts}:
                    facts.append(w)
            want = sorted(facts, key=lambda x: (sentence.find(x), x))
            if (i, n) in got:
                assert got[i, n] == want, sentence
                checked += 1
    assert checked > 500


def naive_rank(parts):
    """The same walk over a matrix filled pair by pair."""
    bags = [Counter(re.findall(r"\w+", s.lower())) for s in parts]
    n = len(bags)
    idf = {w: math.log(n / sum(w in b for b in bags)) + 1 for b in bags for w in b}
    vectors = [{w: c * idf[w] for w, c in b.items()} for b in bags]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    like = lambda i, j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / (norm[i] * norm[j]) if norm[i] and norm[j] else 0
    links = [[j for j in range(n) if like(i, j) >= 0.1] for i in range(n)]
    score = [1 / n] * n
    for _ in range(100):
        new = [0.15 / n + 0.85 * sum(score[j] / max(1, len(links[j])) for j in links[i]) for i in range(n)]
        total = sum(new)
        new = [x / total for x in new]
        done = max(abs(a - b) for a, b in zip(new, score, strict=True)) < 1e-9
        score = new
        if done:
            break
    return score


def test_summaries(spark, texts):
    got = {r.doc_id: r.summary for r in slate.QUERIES["summarize"](spark, SF).collect()}
    for i, t in sorted(texts.items())[:80]:
        parts = [s.strip() for s in M._GAP.split(t) if s.strip()]
        if 0 < len(parts) <= 60:
            score = naive_rank(parts)
            best = sorted(sorted(range(len(parts)), key=lambda k: (-round(score[k], 9), k))[:7])
            assert got[i] == " ".join(parts[k] for k in best)
