import random

from folioframe.llm import neardup as N
from folioframe.operators.components import connected_components
from folioframe.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows, passage, base = [], make(60), make(200)
    for i in range(120):
        rows.append(make(rnd.randint(1, 150)))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(rows[-1])
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(copy)
    rows += [passage + make(40) for _ in range(60)]
    for _ in range(300):  # one large group of near copies
        copy = list(base)
        copy[rnd.randrange(200)] = "changed"
        rows.append(copy)
    texts = [" ".join(r) for r in rows] + ["", None, "  \t", "one", "ONE", "two words", "a b c", "A b\tc"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    want = brute(rows, 3, 85)
    for limit in (256, 40):  # 40: large nodes branch on and meet in blocks
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs, words=3, similarity=0.85, limit=limit, depth=3).collect()}
        assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_sets_of_one_name_stay_apart(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, words=3, similarity=0.85, id_bits=5).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}


def test_recall_at_full_depth(spark):
    """Many classes that resemble one another below the threshold, pairs just above it among them: every large node branches down to the last level."""
    import numpy as np

    r = np.random.default_rng(4)
    base, n = np.arange(200), 1200
    sets = []
    for i in range(n):
        own = np.concatenate([r.choice(base, 160, replace=False), 1000 + i * 100 + np.arange(40)])  # about 0.5 alike
        sets.append(own)
        if i % 4 == 0:  # a partner at 0.852: 184 of 216 words
            sets.append(np.concatenate([r.permutation(own)[:184], 500_000 + i * 100 + np.arange(16)]))
    rows = [(i, " ".join(f"w{w}" for w in s), "en", "s", 1) for i, s in enumerate(sets)]
    found = N.near_duplicates(spark.createDataFrame(rows, DOCS), words=1, similarity=0.85, limit=24).collect()
    groups = {}
    for x in found:
        groups.setdefault(x.component_id, []).append(x.doc_id)
    index = {w: k for k, w in enumerate(sorted({int(w) for s in sets for w in s}))}
    m = np.zeros((len(sets), len(index)), np.float32)
    for i, s in enumerate(sets):
        m[i, [index[int(w)] for w in s]] = 1
    shared = m @ m.T
    size = m.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * shared >= 85 * (size[:, None] + size[None] - shared), 1))
    assert len(a) == n // 4
    component = {x.doc_id: x.component_id for x in found}
    assert all(component[i] == component[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)) and len(groups) == n


def test_query_matches_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.op3_near_duplicates(spark, sf).collect()}
    assert got == want


def test_repeated_ids_nulls_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(5, long, "en", "s", 1), (5, long, "en", "s", 1), (5, "other words here", "en", "s", 1), (7, long + " more", "en", None, 1), (None, long, None, None, None), (8, None, "en", "s", 1), (8, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS + "").withColumnRenamed("lang", "component_id").withColumnRenamed("n_chars", "count")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [(-1, 56, -1, True), (5, 1, 5, True), (5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False), (8, 0, 8, True), (8, 0, 8, True)]
    kept = sorted((r.doc_id or -1, r.text or "") for r in N.keep_one(docs).collect())
    assert (7, long + " more") not in kept and kept.count((5, long)) == 1 and len([k for k in kept if k[0] == 8]) == 2 and kept[0] == (-1, long)
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.keep_one(docs.limit(0)).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5000, 5000), (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_word_hashes_follow_the_words():
    import numpy as np

    from folioframe.llm.words import words_of

    texts = ["", None, " \t\r\n\x0b\x0c", "One one ONE two", "é É x\x1cy a b", "w" * 3000 + " " + "v" * 10, " ".join(f"t{i % 977}" for i in range(9000)), " lead and trail "]
    for t in texts:
        words = words_of(t)
        for part in (64, 1 << 18):
            h = N.word_hashes(t, part)
            assert len(h) == len(words)
            assert len(set(h.tolist())) == len(set(words)) == len({(a, b) for a, b in zip(words, h.tolist(), strict=True)})
    assert np.array_equal(N.word_hashes("abc x", 64), N.word_hashes("  ABC  x"))
