from folioframe.llm import quality as Q
from folioframe.session import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op5_quality(spark, sf)
    rows = got.join(table(spark, sf, "labels"), "doc_id").filter("held_out").selectExpr("score", "text_score", "kept", "quality").collect()
    right = sum(r.kept == bool(r.quality) for r in rows) / len(rows)
    most = max(sum(r.quality for r in rows), len(rows) - sum(r.quality for r in rows)) / len(rows)
    bad = [r for r in rows if not r.quality]
    print(len(rows), right, most, sum(not r.kept for r in bad), len(bad))
    assert right > most and sum(not r.kept for r in bad) > 0.5 * len(bad)
    assert sum(r.kept for r in rows if r.quality) > 0.97 * sum(r.quality for r in rows)


def test_awkward_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = Q.co_train(docs, table(spark, sf, "labels"), rounds=2)
    odd = spark.createDataFrame([(1, None, None, None, None, 1.0), (1, "", "en", "s", 0, 2.0), (None, "w " * 300_000, "en", "s", 1, 3.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    assert all(0 <= r.score <= 1 for r in Q.score_quality(odd, model).collect()) and Q.score_quality(odd, model).count() == 3
    assert Q.score_quality(docs.limit(0), model).count() == 0
    none = Q.co_train(docs, table(spark, sf, "labels").limit(0))
    assert all(r.score > 0.99 for r in Q.score_quality(odd, none).collect())
    assert Q.co_train(docs.limit(0), table(spark, sf, "labels")).both[0] == 0.5


def test_upper_case_share_is_that_of_the_whole_text():
    share = lambda text: Q.Features().text(text)[1][6]
    for n in (1, 300, 500, 700, 1_000, 5_000):
        assert abs(share("Abcd " * n) - 0.2) < 1e-9
    assert abs(share("aB" * 5_000) - 0.5) < 1e-9


def test_lessons_equal_brute_force(spark):
    import numpy as np

    from folioframe.llm.words import remainder

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    r = np.random.default_rng(3)
    weights, limits = [r.normal(size=d) for d in Q.VIEWS], [(-0.4, 0.4), (-1.0, 1.5)]
    labelled = {x.doc_id for x in Q._wanted(labels, Q.LABELLED).collect()}
    want = {}
    for x in docs.withColumn("f", remainder(docs.doc_id, Q.FOLDS)).withColumn("k", remainder(docs.doc_id, Q.BUCKETS * Q.FOLDS)).collect():
        if x.f == Q.HELD_OUT or x.doc_id in labelled:
            continue
        views = Q.Features().of(x.text, x.lang, x.source, x.n_chars)
        scores = [sum(float(value) * weights[v][at] for at, value in zip(*views[v], strict=True)) for v in (0, 1)]
        for v in (0, 1):
            if scores[v] <= limits[v][0] or scores[v] >= limits[v][1]:
                want.setdefault((1 - v, int(scores[v] > 0), x.k // Q.FOLDS), []).append(views[1 - v])
    got = Q.taught(docs, labels, weights, limits)
    assert sum(map(len, got)) == len(want) > 8
    lessons = iter(sorted(want))
    for view in (0, 1):
        for (places, values), label, n in got[view]:
            key = next(lessons)
            mean = np.zeros(Q.VIEWS[view])
            for at, value in want[key]:
                np.add.at(mean, at, value / len(want[key]))
            assert key[:2] == (view, label) and n == len(want[key])
            assert np.allclose(mean[places], values) and np.count_nonzero(mean) == np.count_nonzero(values)


def test_views_are_separate():
    f = Q.Features()
    assert f.of("a text", "en", "s", 6)[1][0].tolist() == f.of("quite another\n\ntext", "en", "s", 6)[1][0].tolist()
    assert f.of("a text", "en", "s", 6)[0][1].tolist() == f.of("a text", "de", None, None)[0][1].tolist()
