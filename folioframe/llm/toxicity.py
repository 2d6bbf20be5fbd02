"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: letters in lower case, homoglyphs as the Latin letters
they imitate, digits and signs that stand inside a word as the letters they
replace. Lexicon terms count where they are whole words; an occurrence inside
an exception phrase does not. The sum of the weights is divided by a power of
the text's length, and a logistic curve turns it into a score from 0 to 1.

Everything is learned from labelled rows outside the held-out fold, from a
bounded sample of them (``SAMPLE`` rows with the smallest hash of their id,
repeated texts once). A term is a word with high odds to stand in toxic
texts; its evidence is counted in distinct neighbourhoods (the words before
and after it), so words that only travel along in copies of one toxic text are
not learned. The weight is the term's
log odds. An exception phrase is a term with a neighbouring word whose
texts are mostly not toxic. Length exponent and curve minimise log loss. As many
terms are learned as pass the thresholds; a term stands in a share of the toxic
texts, so their number is bounded by the sample.

Defined cases: null and empty texts score as texts without hits; rows with
equal ids are scored separately; with no labels at all every score is 0; an
empty table gives an empty result; input columns named ``score`` or
``predicted`` give way to the results, other columns are kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.spread import sliced
from folioframe.llm.words import remainder
from folioframe.session import materialize, table

SAMPLE = 20_000
MIN_TEXTS = 5
MIN_SHARE = 0.005
MIN_ODDS = 2.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

#: Cyrillic and Greek letters and the Latin letters they look like.
HOMOGLYPHS = str.maketrans("абвгеѕіїјкмнорстухузԁԛԝαβγεηικνορτυχ", "abbresiijkmhopctyxy3dqwabyenikvoptux")
#: Digits and signs and the letters they replace inside words.
SUBSTITUTES = str.maketrans("01345789@$", "oieastbgas")
_RUN, _PART, _LETTER = re.compile(r"[0-9@$]+"), re.compile(r"[0-9]+|[@$]+"), re.compile(r"[^\W\d_]")
_WORD = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[@$]*[^\W\d_])|[@$]+(?=[0-9@$]*[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def _substituted(m: re.Match) -> str:
    """A run of digits and signs, read as letters where it touches a word.

    Digits right behind a letter are letters; before a letter all signs of the
    run are, and its last digits.
    """
    text, parts = m.string, _PART.findall(m[0])
    behind, before = m.start() > 0 and _LETTER.match(text, m.start() - 1), _LETTER.match(text, m.end())
    if not before and not (behind and parts[0][0].isdigit()):
        return m[0]
    last = max((i for i, p in enumerate(parts) if p[0] not in "@$"), default=-1)
    read = lambda i, p: before if p[0] in "@$" else (i == 0 and behind) or (i == last and before)
    return "".join(p.translate(SUBSTITUTES) if read(i, p) else p for i, p in enumerate(parts))


def fold(text: str | None) -> str:
    """Lower case, homoglyphs and substitutes replaced, in one pass over each run."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    return _RUN.sub(_substituted, text)


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the score's curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.0
    bias: float = -30.0
    slope: float = 0.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w, term))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None, phrase))
        a.make_automaton()
        return a

    def score(self, total: float, n: int) -> float:
        x = self.bias + self.slope * total / (1.0 + n) ** self.power
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def hits(folded: str, automaton) -> list[tuple[int, int, float, str]]:
    """Whole-word terms (start, end, weight, term) outside exception phrases."""
    found, shields = [], []
    if not len(automaton):
        return found
    last = len(folded) - 1
    for end, (size, weight, term) in automaton.iter(folded):
        start = end - size + 1
        if (start and folded[start - 1].isalnum()) or (end < last and folded[end + 1].isalnum()):
            continue
        (found if weight is not None else shields).append((start, end + 1, weight, term))
    if not shields:
        return found
    #: the farthest end of the phrases that start at or before each start
    shields.sort(key=lambda s: s[0])
    starts, ends = [s[0] for s in shields], []
    for s in shields:
        ends.append(max(s[1], ends[-1]) if ends else s[1])
    return [h for h in found if h[0] < starts[0] or ends[bisect_right(starts, h[0]) - 1] < h[1]]


def neighbours(folded: str, found: list[tuple[int, int, float, str]]) -> tuple[list[str], list[str]]:
    """The whole words before and after each hit, empty at the text's ends."""
    if not found:
        return [], []
    spans = [m.span() for m in _WORD.finditer(folded)]
    starts = [s for s, _ in spans]
    word = lambda i: folded[spans[i][0] : spans[i][1]] if 0 <= i < len(spans) else ""
    return [word(bisect_left(starts, h[0]) - 1) for h in found], [word(bisect_left(starts, h[1])) for h in found]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(bias, slope, log loss) of a one-variable logistic fit, lightly penalised."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([0, 1e-3]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def labelled_sample(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(``text``, ``y``) of at most ``sample`` labelled texts outside the held-out fold."""
    wanted = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (remainder(F.col(doc_id), FOLDS) != HELD_OUT))
    wanted = wanted.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    #: the broadcast side has at most ``sample`` rows
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(wanted), "_id")
    return chosen.filter("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("_hash")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, **options: object) -> Lexicon:
    """The lexicon, from a bounded sample of labelled rows. What reaches the driver is bounded by the sample."""
    rows = materialize(labelled_sample(docs, labels, **options), "toxicity-sample")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon(bias=30.0 if n_pos else -30.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(set(_WORD.findall(fold(t))))
            keys = list(seen[1] | seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["term", "pos", "neg"])

    counts = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log(((F.col("pos") + 0.1) / (n_pos + 0.1)) / ((F.col("neg") + 0.1) / (n_neg + 0.1)))
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * n_pos))
    named = counts.filter((F.col("pos") >= least) & (F.length("term") > 1)).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    #: a term stands in ``least`` texts of the sample, so there are few
    top = {r["term"]: r["odds"] for r in named.collect()}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(top).automaton()
        for batch in batches:
            out: dict[str, list] = {"y": batch.column(1).to_pylist(), "n": [], "terms": [], "before": [], "after": []}
            for t in batch.column(0).to_pylist():
                folded = fold(t)
                found = hits(folded, automaton)
                out["n"].append(len(folded))
                out["terms"].append([h[3] for h in found])
                before, after = neighbours(folded, found)
                out["before"].append(before)
                out["after"].append(after)
            kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.string())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    #: at most SAMPLE rows, each with the hits of one text
    texts = rows.mapInArrow(incidence, "y int, n long, terms array<string>, before array<string>, after array<string>").collect()
    #: evidence is counted in distinct neighbourhoods: near copies repeat theirs
    around: tuple[set, set] = set(), set()
    for r in texts:
        around[r["y"]].update(zip(r["terms"], r["before"], r["after"], strict=True))
    pos, neg = (Counter(t for t, _, _ in a) for a in (around[1], around[0]))
    weights: dict[str, float] = {}
    for t in sorted(pos):
        w = math.log(((pos[t] + 0.1) / (n_pos + 0.1)) / ((neg[t] + 0.1) / (n_neg + 0.1)))
        if pos[t] >= least and w >= MIN_ODDS:
            weights[t] = w
    phrases: tuple[Counter, Counter] = Counter(), Counter()
    for r in texts:
        for t, b, a in set(zip(r["terms"], r["before"], r["after"], strict=True)):
            if t in weights:
                phrases[r["y"]].update(p for p in (f"{b} {t}" if b else "", f"{t} {a}" if a else "") if p)
    exceptions = sorted(p for p, c in phrases[0].items() if c >= MIN_TEXTS and c / n_neg > 2 * phrases[1][p] / n_pos)
    total, size, y = (np.array(x, float) for x in zip(*((sum(weights.get(t, 0.0) for t in r["terms"]), r["n"], r["y"]) for r in texts), strict=True))
    found = min(((*_logistic(total / (1 + size) ** p, y), p) for p in (0.125, 0.25, 0.5, 0.75, 1.0)), key=lambda f: f[2])
    return Lexicon(weights, exceptions, found[3], found[0], found[1])


def ratings(texts: pa.Array, lexicon: Lexicon, automaton) -> list[float]:
    """The score of each text."""
    scores = []
    for value in texts:
        folded = fold(value.as_py())
        scores.append(lexicon.score(sum(h[2] for h in hits(folded, automaton)), len(folded)))
    return scores


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` and ``predicted``."""
    keep = docs.columns if keep is None else keep
    clash = {"score", "predicted"}

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in sliced(batches):
            scores = ratings(batch.column(batch.num_columns - 1), lexicon, automaton)
            flags = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(flags, pa.int32())], [*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(*(c for c in keep if c not in clash), F.col(text).alias("_toxic_text"))
    schema = rows.drop("_toxic_text").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(rate, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, unchanged."""
    lexicon = learn(docs, labels)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in sliced(batches):
            yield batch.filter(pa.array([s < THRESHOLD for s in ratings(batch.column(at), lexicon, automaton)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op7_score_toxicity(spark, sf_dir):
    """Every document's toxicity, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
