import os
import random
import re
from collections import Counter

import duckdb
import pytest

from folioframe.llm import phrases as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, longest, least, first):
    """The contract with one counter per language."""
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n["und" if lang is None else lang] += len(words)
            counts.update(words[i : i + k] for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        big = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in big.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in big.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:first])]
    return sorted(out)


def texts(rng, n):
    common = "the of and a to".split()
    rare = [f"w{i}" for i in range(40)] + ["naïve", "漢字", "X", "\x1fodd", "\x00"]
    idioms = ["as well as the", "New York City council of", "one one one one one one one", "a b a b a b"]
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts.append(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) if rng.random() < 0.7 else rng.choice(idioms))
            if rng.random() < 0.15:
                parts.append(rng.choice([",", ". ", " ;", "\n", "\t", "\x0b", "  ", "?!"]))
        yield " ".join(parts), rng.choice(["en", "en", "fr", None, "und"])


@pytest.mark.parametrize("options", [{}, {"block_words": 150, "shards": 4}, {"block_words": 60, "shards": 1}])
def test_equals_brute_force(spark, options):
    rows = list(texts(random.Random(7), 220)) + [(None, "en"), ("", None), ("only , . ; marks", "xx"), ("long " * 3000, "en")]
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(rows)], DOCS).withColumnRenamed("source", "phrase").withColumnRenamed("n_chars", "block").repartition(3)
    got = sorted(tuple(r) for r in P.collocations(docs, least=8, first=60, **options).collect())
    want = brute(rows, 5, 8, 60)
    assert got == want and len(want) > 40


def test_sql_says_the_same(spark):
    rows = list(texts(random.Random(11), 900))
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(rows)], DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.execute(P.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in P.collocations(docs, block_words=500).collect()) == want == brute(rows, 5, 100, 2000)


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, " .", "en", "s", 0), (2, None, None, "s", 0)], DOCS)
    assert P.collocations(docs).count() == 0 and P.collocations(docs.limit(0)).count() == 0


def test_exact_beyond_64_bits(spark):
    value = spark.sql("select cast((cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint) as x from values (1234567890123L, 98765432109876L, 1234567890124L, 1234567890999L) as t(a, n, l, r)").first().x
    assert value == 1000 * 1234567890123 * 98765432109876 // (1234567890124 * 1234567890999)


def test_tables_go_when_their_lengths_are_complete(spark, monkeypatch):
    """Told tables live for one round; posts that only hold complete lengths are gone before the next are summed."""
    live, told_rounds, alive = {}, [], []
    make, make_by, drop = P.materialize, P.materialize_by, P.discard

    def materialize(df, name, **options):
        if name == "phrases-told" and not any(n == name for n, _ in live.values()):
            alive.append([sorted({r.k for r in d.selectExpr("(m & 31) >> 1 as k").distinct().collect()}) for n, d in live.values() if n == "phrase-posts"])
        if name == "phrase-posts":
            told_rounds.append(sum(n == "phrases-told" for n, _ in live.values()))
        out = make(df, name, **options)
        live[id(out)] = name, out
        return out

    monkeypatch.setattr(P, "materialize", materialize)
    def materialize_by(df, name, by, **options):
        out = make_by(df, name, by, **options)
        live.update({id(d): (name, d) for d in out.values()})
        return out

    def discard(df):
        live.pop(id(df), None)
        files = [f.removeprefix("file://") for f in df.inputFiles()]
        drop(df)
        assert not any(map(os.path.exists, files))

    monkeypatch.setattr(P, "materialize_by", materialize_by)
    monkeypatch.setattr(P, "discard", discard)
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, (t, g) in enumerate(texts(random.Random(3), 120))], DOCS).repartition(2)
    P.collocations(docs, least=8, first=60, block_words=60)
    assert max(told_rounds) <= P.SHARDS * P.TURNS
    for n, tables in enumerate(alive, 1):
        assert all(min(ks, default=99) >= min(n - P.SHARDS + 1, P.LONGEST) for ks in tables), (n, tables)
    assert not {n for n, _ in live.values()} & {"phrase-posts", "phrases-told", "phrases-ended"}
