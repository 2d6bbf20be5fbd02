import math

import numpy as np
import pytest

from folioframe.llm import topk as T
from folioframe.session import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """query_id -> [(vec_id, score)] for usable rows of the most frequent length."""
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in ok]
    d = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    ok = [(i, np.array(v)) for i, v in ok if len(v) == d]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 20 == 0:
            found = sorted((-int(a @ b), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def some_points(spread, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 16)) * 40
    return np.floor(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 40 * spread).astype(np.int64)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_tree_search_is_exact_and_trees_keep_their_promises(spread):
    x, q = some_points(spread, 3000), some_points(spread, 90, 2)
    ids = np.random.default_rng(3).permutation(3000).astype(np.int64)
    tree = T.CoverTree(x.astype(float), leaf=32)
    far = lambda rows, c: np.sqrt(((tree.x[rows] - c) ** 2).sum(axis=1))
    for rows, c, r, kids in zip(tree.order, tree.centre, tree.radius, tree.children, strict=True):
        assert far(rows, c).max() <= r + 1e-9 and (tree.x[rows[0]] == c).all()
        if kids:
            assert sorted(np.concatenate([tree.order[k] for k in kids])) == sorted(rows)  # covering
            assert (tree.centre[kids[0]] == c).all() and all(tree.radius[k] <= r / 2 + 1e-9 for k in kids)  # nesting
            centres = np.array([tree.centre[k] for k in kids])
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert gaps[~np.eye(len(kids), dtype=bool)].min() > r / 2  # separation
    best = T.Best(90, 7, np.full(90, T.LOWEST))
    met = T.dual_search(T.CoverTree(q.astype(float), leaf=8), tree, q, x, ids, np.arange(3000), best)
    assert met < 90 * 3000 * (0.3 if spread < 1 else 1.01)
    score = q @ x.T
    for i in range(90):
        want = np.lexsort((ids, -score[i]))[:7]
        assert list(best.name[i]) == list(want) and list(best.score[i]) == list(score[i][want])


def test_large_components_are_exact():
    a = np.array([[1 << 30, 1, 3], [-(1 << 30), 5, 7]])
    assert T.scores(a, a).tolist() == [[(1 << 60) + 10, -(1 << 60) + 26], [-(1 << 60) + 26, (1 << 60) + 74]]
    best = T.Best(2, 2, np.full(2, T.LOWEST))
    best.offer(np.arange(2), T.scores(a, a), np.array([5, 4]), np.array([0, 1]))
    assert best.name.tolist() == [[0, 1], [1, 0]]


def frame_of(spark, x, every=20):
    return spark.createDataFrame([(i, [float(v) / 64 for v in row], 0) for i, row in enumerate(x)], SCHEMA)


def test_clusters_are_pruned_over_deep_trees(spark, monkeypatch):
    for name, value in {"BLOCK": 64, "QUERY_BLOCK": 16, "PIVOTS": 4, "CELL_SAMPLE": 200, "GROUP": 150, "LEAF": 16, "TILE": 3}.items():
        monkeypatch.setattr(T, name, value)
    x = some_points(0.03, 2400)
    frame = frame_of(spark, x)
    assert sorted(map(tuple, T.top_k(frame).collect())) == brute([(i, [v / 64 for v in row]) for i, row in enumerate(x.tolist())], 20)
    met, every = T.pairs_met(frame)
    assert met < 0.6 * every


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, T.op2_top_k(spark, sf).collect())) == brute(rows, 20)


def test_hot_vectors_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 8]) for i in range(1, 120)]
    rows += [(i, [0.25, 0.25, 0.0, 0.5]) for i in range(200, 320)]  # one common vector
    rows += [(1000, None), (1020, [float("nan"), 0.0, 0.0, 0.0]), (1040, [float("inf"), 0.0, 0.0, 0.0]), (1060, [None, 0.0, 0.0, 0.0]), (1080, [1.0]), (None, [0.0] * 4), (1100, [])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnRenamed("label", "rank")
    assert sorted(map(tuple, T.top_k(frame).collect())) == brute(rows, 20)
    huge = spark.createDataFrame([(20, [1e300, 1.0], 0), (40, [1e300, 2.0], 0), (60, [1.0, 1.0], 0), (1, [2.0**20, 1.0], 0)], SCHEMA)
    assert [tuple(r) for r in T.top_k(huge).collect()] == [(60, 1, 1, 64 * 64 * 2**20 + 64 * 64)]
    few = spark.createDataFrame([(20, [0.5, 0.1], 0), (1, [0.5, -0.5], 0)], SCHEMA)
    assert [tuple(r) for r in T.top_k(few).collect()] == [(20, 1, 1, 32 * 32 + 6 * -32)]
    assert T.top_k(few.limit(0)).count() == 0 and T.top_k(few.filter("vec_id = 20")).count() == 0


def test_large_finite_vectors_take_part(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0] * 64), (1, [1e6] * 64), (2, [1e7] + [0.0] * 63), (20, [0.5] * 64), (3, [float("inf")] * 64), (40, [-3e6] * 64)]
    rows += [(100 + i, (rng.normal(size=64) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(300)]
    got = T.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i != 3]
    for q, a in ok:
        if q % 20 == 0:
            want = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q)[:20]
            assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
