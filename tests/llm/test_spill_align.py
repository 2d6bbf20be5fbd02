import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioframe.llm import spill_align as S
from folioframe.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def byte_letters():
    """The printable stand-ins of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    """The contract, document by document and pair by pair, from the json file and the model file."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, found, counts = byte_letters(), [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                own_a, own_b = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        own_a.append(a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        own_b.append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        found.append(groups)
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = []
    for groups in found:
        links = [(x, y) for p, q in groups for x in p for y in q]
        digest = hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups).encode()).hexdigest() if groups else ""
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), digest, sum(counts[k] == top[k[0]] for k in links), sum(counts[k] for k in links)))
    return out


ODD = [None, "", " ", "  ", "a", "<|endoftext|> x <s> </s> <unk>", "▁ sign", "naïve café 漢字 😀‍ العربية", "\n\n\t x", "a" * 5000, " " * 3000 + "z", "don't  stop", "İ́ ﬁ 　", "\x00 nul", "word " * 4000, "ab\r\ncd", "𝔘𝔫𝔦"]


def rows_of(texts):
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def result(rows):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows}


@pytest.mark.parametrize("options", [{}, {"radix": 4, "fan": 2, "block_records": 50}])
def test_equals_brute_force(spark, options):
    rng = random.Random(3)
    words = "the a of naïve tokenisation antidisestablishmentarianism 12345 foo_bar x.y -- “q” über 漢字仮名".split()
    texts = ODD + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)] + ["same text"] * 5
    docs = spark.createDataFrame(rows_of(texts), DOCS).withColumnRenamed("lang", "block").withColumnRenamed("source", "radix").repartition(3)
    assert result(S.alignment(docs, **options).collect()) == dict(enumerate(brute(texts)))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = S.op12_align_tokenizers(spark, sf).collect()
    assert result(got) == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))


def test_equal_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x y", "e", "s", 1), (1, "x y", "e", "s", 1), (None, "x", "e", "s", 1)], DOCS)
    got = sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in S.alignment(docs).collect())
    assert got == [(0, 1, 3), (1, 2, 5), (1, 2, 5)]
    assert S.alignment(docs.limit(0)).count() == 0


def test_crowded_groups_go_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 500), rng.integers(0, 20, 400)
    ga, gb = np.sort(rng.integers(0, 9, 500)), np.sort(rng.integers(0, 9, 400))
    want = S.link_pairs(a, b, ga, gb, 9)
    monkeypatch.setattr(S, "PLAIN_PAIRS", 100)
    got = S.link_pairs(a, b, ga, gb, 9)
    assert want[2] == got[2] and (want[0] == got[0]).all() and (want[1] == got[1]).all()
    brute_links = Counter((x << S.ID_BITS) | y for x, g in zip(a.tolist(), ga, strict=True) for y, h in zip(b.tolist(), gb, strict=True) if g == h)
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == brute_links


def test_merge_keeps_order_and_sums():
    rng, runs, want = random.Random(5), [], Counter()
    for _ in range(40):
        keys = sorted(rng.sample(range(5000), rng.randint(1, 900)))
        counts = [rng.randint(1, 9) for _ in keys]
        want.update(dict(zip(keys, counts, strict=True)))
        runs.append(S.chunks(np.array(keys), np.array(counts), size=64))
    parts = list(S.merged(runs))
    keys, sums = (np.concatenate(c) for c in zip(*parts, strict=True))
    assert keys.tolist() == sorted(want) and dict(zip(keys.tolist(), sums.tolist(), strict=True)) == want


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 300_000, "é" * 200_000, "\n" * 300_000, "漢" * 100_000, "1" * 300_000])
def test_long_runs_end(text):
    first, second = S.sides()
    digest, keys, links = S.align(text, first, second)
    assert digest[3] == links.sum() and len(keys) == len(set(keys.tolist()))
