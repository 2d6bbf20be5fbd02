import random

from folioframe.llm import toxicity as X
from folioframe.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_fold():
    assert X.fold("1D10T") == "idiot" and X.fold("$tupid l0ser") == "stupid loser" and X.fold("stupid$$$ 1984") == "stupid$$$ 1984"
    assert X.fold("сlоwn") == "clown" and X.fold(None) == "" and X.fold("idi0t!") == "idiot!"


def test_hits_are_whole_words_outside_exceptions():
    lex = X.Lexicon({"trash": 2.0, "loser": 1.0}, ["trash can"])
    a = lex.automaton()
    assert [h[3] for h in X.hits("trash! a trash can, trashy loser", a)] == ["trash", "loser"]
    assert X.hits("anything", X.Lexicon().automaton()) == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = X.op7_score_toxicity(spark, sf)
    rows = got.join(table(spark, sf, "labels"), "doc_id").filter("held_out").selectExpr("score", "predicted", "toxic").collect()
    tp = sum(r.predicted and r.toxic for r in rows)
    assert tp / sum(r.toxic for r in rows) > 0.75 and tp / sum(r.predicted for r in rows) > 0.95
    assert got.count() == 10_000 and all(0 <= r.score <= 1 for r in got.collect())


def test_awkward_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    lexicon = X.learn(docs, table(spark, sf, "labels"))
    assert "idiot" in lexicon.weights
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "you 1d10t", "en", "s", 1), (2, "word " * 200_000, "en", "s", 1)], DOCS).withColumnRenamed("lang", "score")
    got = X.score_toxicity(odd, lexicon, keep=["doc_id", "score"]).collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0)]
    none = X.learn(docs, table(spark, sf, "labels").limit(0))
    assert X.score_toxicity(docs.limit(5), none).filter("predicted = 1").count() == 0
    assert X.score_toxicity(docs.limit(0), lexicon).count() == 0
    assert X.drop_toxic(docs, table(spark, sf, "labels")).columns == docs.columns


def naive_hits(folded, lexicon):
    """Every term and phrase tried at every place."""
    whole = lambda s, e: not (s and folded[s - 1].isalnum()) and not (e < len(folded) and folded[e].isalnum())

    def places(t):
        at, found = folded.find(t), []
        while at >= 0:
            if whole(at, at + len(t)):
                found.append((at, at + len(t)))
            at = folded.find(t, at + 1)
        return found

    shields = [p for x in lexicon.exceptions for p in places(x)]
    return sorted((s, e, w, t) for t, w in lexicon.weights.items() for s, e in places(t) if not any(a <= s and e <= b for a, b in shields))


def test_query_equals_naive_matching(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    lexicon = X.learn(docs, table(spark, sf, "labels"))
    want = {}
    for r in docs.collect():
        folded = X.fold(r.text)
        want[r.doc_id] = lexicon.score(sum(h[2] for h in naive_hits(folded, lexicon)), len(folded))
    got = {r.doc_id: (r.score, r.predicted) for r in X.op7_score_toxicity(spark, sf).collect()}
    assert got.keys() == want.keys() and lexicon.weights
    assert all(abs(got[k][0] - v) < 1e-9 and got[k][1] == (v >= 0.3) for k, v in want.items())


def test_hits_and_neighbours_by_brute_force():
    lex = X.Lexicon({"trash": 2.0, "can": 1.0, "bad": 1.0}, ["trash can", "a trash can here", "not bad"])
    a = lex.automaton()
    for text in ("a trash can here can", "not bad, bad trash", "trash can trash", "canbad can", "", "trash " * 50 + "can"):
        assert sorted(X.hits(text, a)) == naive_hits(text, lex)
    found = X.hits("very--long" + "x" * 60 + " trash  sh", a)
    assert X.neighbours("very--long" + "x" * 60 + " trash  sh", found) == (["long" + "x" * 60], ["sh"])
    assert X.neighbours("trash", X.hits("trash", a)) == ([""], [""])


def test_long_texts_are_linear():
    import time

    lex = X.Lexicon({"trash": 2.0}, ["trash can"])
    began = time.perf_counter()
    assert len(X.hits("trash can trash " * 60_000, lex.automaton())) == 60_000
    assert time.perf_counter() - began < 5


def test_runs_of_signs_and_digits_fold_in_one_pass():
    import re
    import time

    told = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[@$]*[^\W\d_])|[@$]+(?=[0-9@$]*[^\W\d_])")
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab01 @$5_é²٣-") for _ in range(rng.randint(0, 12)))
        assert X.fold(text) == told.sub(lambda m: m[0].translate(X.SUBSTITUTES), text)
    for text in ("@" * 10**6, "$" * 10**6 + " ", "1" * 10**6, "a" + "1@" * 500_000, "$1" * 500_000 + "a", "1@ " * 300_000):
        began = time.process_time()
        X.fold(text)
        assert time.process_time() - began < 3
