"""Quality classification by co-training two views of a document.

The text view sees words (hashed) and the texture of the text; the metadata
view sees language, source and the recorded length, and nothing of the text.
Each has a logistic classifier. Both start from labelled rows; in each of
``rounds`` rounds, every unlabelled row of the corpus that one view is sure of
is taught to the other. "Sure" is a score beyond limits that the same share of
labelled rows passes which the view has not learned from. What a view is taught
is summed where the rows are: per label, ``BUCKETS`` mean rows reach the driver,
whatever the size of the corpus, and count as much as a fixed share of the
labelled rows. Each view is then calibrated on labelled rows that neither
learned from, and the calibrated log odds of both are combined by a logistic fit
on the same rows. All documents are scored with both views in one pass.

Learning uses a bounded sample of labelled rows (``LABELLED`` rows with the
smallest hash of their id); rows of the held-out fold take no part in learning.
Word and texture features of one document are computed from its whole text.

Defined cases: null texts, languages, sources and lengths have features of their
own; rows with equal ids are scored separately; without labels of both classes
every score is the share of good labels (1 without labels); an empty table gives
an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.neardup import word_hashes
from folioframe.llm.words import remainder
from folioframe.session import table

LABELLED = 6_000
ROUNDS = 2
#: Share of the rows that a view is sure of, and of the labelled rows that what it teaches counts for.
EXCHANGED, PSEUDO_WEIGHT = 0.05, 0.1
BUCKETS = 4
FOLDS, HELD_OUT, CALIBRATION = 10, 0, 1
WORD_DIMS = 1 << 14
META_DIMS = 1 << 9


class Features:
    """Sparse features (places, values) of the two views of a row."""

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at = (word_hashes(text) % np.uint64(WORD_DIMS - 16)).astype(np.int32) + 16
        places, counts = np.unique(at, return_counts=True)
        n = max(1, len(at))
        raw = text or ""
        size = max(1, len(raw))
        signs = sum(raw.count(c) for c in "#$%&*|!")
        texture = [1.0, min(1.0, signs / n), len(places) / n, (counts.max() if len(at) else 0) / n, size / n / 10.0, sum(map(raw.count, "0123456789")) / size * 10, sum(map(str.isupper, raw)) / size]
        values = np.sqrt(counts / n)
        return np.concatenate([np.arange(len(texture)), places]).astype(np.int32), np.concatenate([texture, values])

    def meta(self, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        size = np.log1p(max(0, n_chars or 0)) / 10
        numbers = [1.0, size, size * size, float(n_chars is None)]
        named = [16 + zlib.crc32(f"{k}={v}".encode()) % (META_DIMS - 16) for k, v in (("lang", lang), ("source", source), ("size", int(size * 10)), ("both", f"{lang}/{source}"))]
        return np.array([*range(len(numbers)), *named], np.int32), np.array([*numbers, 1.0, 1.0, 1.0, 1.0])

    def of(self, text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The rows of both views."""
        return [self.text(text), self.meta(lang, source, n_chars)]


VIEWS = (WORD_DIMS, META_DIMS)


class Sparse:
    """Rows of sparse features as one flat matrix."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], dims: int) -> None:
        self.dims, self.n = dims, len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
        self.place = np.concatenate([p for p, _ in rows]) if rows else np.empty(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.place], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * r[self.row], minlength=self.dims)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 80) -> np.ndarray:
    """Weights of a penalised logistic regression, by accelerated gradient steps."""
    curve = x.back(weight * x.dot(np.ones(x.dims)) / 4) + penalty  # bounds the curvature of every weight
    w = np.zeros(x.dims)
    ahead = w.copy()
    for k in range(steps):
        g = x.back(weight * (_sigmoid(x.dot(ahead)) - y)) + penalty * ahead
        new = ahead - g / np.maximum(curve, 1e-9)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_dense(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic fit of a few dense columns and a constant (last), by Newton's steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = _sigmoid(a @ w)
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -3, 3)
    return w


@dataclass
class Model:
    """Both views' weights, their calibrations (slope, constant) and the combination."""

    text: np.ndarray
    meta: np.ndarray
    text_curve: np.ndarray
    meta_curve: np.ndarray
    both: np.ndarray

    def scores(self, text: tuple, meta: tuple) -> tuple[float, float, float]:
        t = float(text[1] @ self.text[text[0]]) * self.text_curve[0] + self.text_curve[1]
        m = float(meta[1] @ self.meta[meta[0]]) * self.meta_curve[0] + self.meta_curve[1]
        c = self.both[0] * t + self.both[1] * m + self.both[2]
        return tuple(float(v) for v in _sigmoid(np.array([t, m, c])))


def _sample(docs: DataFrame, labels: DataFrame, n_labelled: int) -> list[tuple]:
    """(rows of the views, label, fold) of a bounded sample of labelled rows, by id."""
    fold = remainder(F.col("doc_id"), FOLDS)
    #: at most n_labelled rows
    rows = docs.join(F.broadcast(_wanted(labels, n_labelled)), "doc_id").select("doc_id", "y", fold.alias("fold"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            tp, tv, mp, mv = [], [], [], []
            for r in batch.to_pylist():
                a, b = features.of(r["text"], r["lang"], r["source"], r["n_chars"])
                tp.append(a[0]), tv.append(a[1].astype(np.float32)), mp.append(b[0]), mv.append(b[1].astype(np.float32))
            arrays = [pa.array(tp, pa.list_(pa.int32())), pa.array(tv, pa.list_(pa.float32())), pa.array(mp, pa.list_(pa.int32())), pa.array(mv, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], ["doc_id", "y", "fold", "tp", "tv", "mp", "mv"])

    found = rows.mapInArrow(extract, "doc_id long, y int, fold long, tp array<int>, tv array<float>, mp array<int>, mv array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    array = lambda c, k: np.array(c.values, k)
    cols = [found.column(i).combine_chunks() for i in range(7)]
    return [([(array(cols[3][i], np.int32), array(cols[4][i], float)), (array(cols[5][i], np.int32), array(cols[6][i], float))], cols[1][i].as_py(), cols[2][i].as_py()) for i in range(len(found))]


def _wanted(labels: DataFrame, n_labelled: int) -> DataFrame:
    """(``doc_id``, ``y``) of the labelled rows that are learned from or judged by."""
    known = labels.filter("doc_id is not null and quality is not null").filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    return known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_labelled)


def taught(docs: DataFrame, labels: DataFrame, weights: list[np.ndarray], limits: list[tuple[float, float]], n_labelled: int = LABELLED) -> list[list[tuple[tuple, int, int]]]:
    """What each view is taught: (mean row, label, number of rows) per label and bucket.

    ``limits`` are each view's (low, high): unlabelled rows that score no more,
    or no less, are taught to the other view as bad, or good.
    """
    fold = remainder(F.col("doc_id"), FOLDS)
    pool = docs.filter(F.col("doc_id").isNotNull() & (fold != HELD_OUT)).join(F.broadcast(_wanted(labels, n_labelled).select("doc_id")), "doc_id", "left_anti")
    rows = pool.select(remainder(F.col("doc_id"), BUCKETS * FOLDS).alias("k"), "text", "lang", "source", F.col("n_chars").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast((weights, limits))

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        (w, bounds), sums = shared.value, {}
        for batch in batches:
            for k, text, lang, source, n_chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                views = features.of(text, lang, source, n_chars)
                for v, other in ((0, 1), (1, 0)):
                    at, value = views[v]
                    score = float(value @ w[v][at])
                    label = 0 if score <= bounds[v][0] else 1 if score >= bounds[v][1] else None
                    if label is not None:
                        total = sums.setdefault((other, label, k // FOLDS), np.zeros(VIEWS[other] + 1))
                        np.add.at(total, views[other][0], views[other][1])
                        total[-1] += 1
        for (view, label, bucket), total in sums.items():
            at = np.flatnonzero(total)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.int32()) for x in (view, label, bucket)] + [pa.array(at, pa.int32()), pa.array(total[at])], ["view", "label", "bucket", "place", "total"])

    partial = rows.mapInArrow(teach, "view int, label int, bucket int, place int, total double")
    #: at most 2 labels * BUCKETS rows per feature
    found = partial.groupBy("view", "label", "bucket", "place").agg(F.sum("total").alias("total")).toArrow().sort_by([(c, "ascending") for c in ("view", "label", "bucket", "place")])
    cols = [found.column(c).to_numpy() for c in ("view", "label", "bucket", "place", "total")]
    out: list[list[tuple[tuple, int, int]]] = [[], []]
    for view, dims in enumerate(VIEWS):
        for label in (0, 1):
            for bucket in range(BUCKETS):
                mine = (cols[0] == view) & (cols[1] == label) & (cols[2] == bucket)
                at, total = cols[3][mine], cols[4][mine]
                if len(at):
                    n = total[at == dims][0]
                    out[view].append(((at[at < dims].astype(np.int32), total[at < dims] / n), label, int(n)))
    return out


def sure(scores: np.ndarray, share: float) -> tuple[float, float]:
    """The scores that the worst and best of rows pass: ``EXCHANGED`` of them, in the proportions of the classes."""
    return float(np.quantile(scores, EXCHANGED * (1 - share))), float(np.quantile(scores, 1 - EXCHANGED * share))


def co_train(docs: DataFrame, labels: DataFrame, *, n_labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """The model; ``docs`` has doc_id, text, lang, source and n_chars."""
    rows = _sample(docs, labels, n_labelled)
    learn = [r for r in rows if r[2] != CALIBRATION]
    judge = [r for r in rows if r[2] == CALIBRATION]
    share = float(np.mean([r[1] for r in rows])) if rows else 1.0
    if not 0 < share < 1 or len({r[1] for r in learn}) < 2 or len({r[1] for r in judge}) < 2:
        constant = np.array([0.0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
        return Model(np.zeros(WORD_DIMS), np.zeros(META_DIMS), constant, constant, np.array([0.5, 0.5, 0.0]))
    lessons: list[list[tuple[tuple, int, int]]] = [[], []]
    judged = [Sparse([r[0][v] for r in judge], d) for v, d in enumerate(VIEWS)]
    for k in range(rounds + 1):
        weights = []
        for v, d in enumerate(VIEWS):
            y = np.array([r[1] for r in learn] + [label for _, label, _ in lessons[v]], float)
            #: the lessons of a label share the weight of that many labelled rows
            of_label = [max(1, sum(n for _, x, n in lessons[v] if x == label)) for label in (0, 1)]
            class_share = (1 - share, share)
            trust = [PSEUDO_WEIGHT * len(learn) * class_share[label] * n / of_label[label] for _, label, n in lessons[v]]
            weights.append(fit(Sparse([r[0][v] for r in learn] + [x for x, _, _ in lessons[v]], d), y, np.array([1.0] * len(learn) + trust)))
        raw = [x.dot(w) for x, w in zip(judged, weights, strict=True)]
        if k < rounds:
            lessons = taught(docs, labels, weights, [sure(x, share) for x in raw], n_labelled)
    y = np.array([r[1] for r in judge], float)
    curves = [fit_dense(x[:, None], y) for x in raw]
    odds = np.stack([x * c[0] + c[1] for x, c in zip(raw, curves, strict=True)], axis=1)
    return Model(weights[0], weights[1], curves[0], curves[1], fit_dense(odds, y))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(``doc_id``, ``text_score``, ``meta_score``, ``score``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = []
            for _, text, lang, source, n_chars in zip(*(batch.column(i) for i in range(5)), strict=True):
                found.append(shared.value.scores(*features.of(text.as_py(), lang.as_py(), source.as_py(), n_chars.as_py())))
            cols = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", "text_score", "meta_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(rate, "doc_id long, text_score double, meta_score double, score double")


def op5_quality(spark, sf_dir):
    """Every document's quality by both views and their combination."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, co_train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))
