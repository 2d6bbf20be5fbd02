import hashlib
import random
import re
import time

from folioframe.llm import secrets as S
from folioframe.session import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    """Base spans by Python's re."""
    text, found = text or "", []
    a = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, it in enumerate((a.finditer(text), re.finditer(r"AKIA[A-Z0-9]+", text), re.finditer("[0-9a-f]+", text))):
        least = (6, 20, 24)[k]
        found += [(m.start(), k, m.end()) for m in it if len(m[2] if k == 0 else m[0]) >= least]
    return sorted(found)


def digest(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_match_brute_force(spark):
    awkward = [
        None, "", "password=token=abcdef", "secret=token:abcdef", "API_KEY: 'abcdef' apikey=\"123456\"", "\U0001f600é token = abcdef0123 \U0001f600 AKIA" + "A" * 16,
        "AKIAAKIA" + "B" * 12, "AKIA" + "C" * 15, "f" * 23 + " " + "f" * 24, "token=" + "ab12" * 10 + " " + "0" * 30, "x token=abcdef" * 1500, "\n\tpasswd \t= abcdefg passwd   =   abcdefg",
    ]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(awkward)] + [(0, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(table(spark, SF, "documents"))
    got = S.scan_secrets(docs, keep=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    n = 0
    for r in got:
        want = brute(r.text)
        assert [tuple(s) for s in r.base_spans] == want, r.text
        assert set(want) <= {tuple(s) for s in r.all_spans}
        n += len(want)
    assert n > 1500


def test_weak_parts_need_their_complement(spark):
    key = "Zx9" + "aB3d" * 10
    texts = {
        1: f"username: alice {key}",  # linked
        2: f"username: alice {'word ' * 60}{key}",  # too far apart
        3: f"only {key} here",
        4: "username: alice and nothing more, see https://a.example/x",
        5: f"see https://svc.example:8080/login {key}",
        6: f"{key} {'- ' * 95}username: alice",  # across a bucket border
    }
    rows = [(i, t, "en", "s", 1) for i, t in texts.items()] * 2
    got = {r.doc_id: {S.KINDS[s.kind] for s in r.all_spans} for r in S.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == {"login", "opaque"} and got[5] == {"endpoint", "opaque"} and got[6] == {"login", "opaque"}
    assert not got[2] and not got[3] and not got[4]


def test_redaction_and_query(spark):
    rows = [(1, 'a token = "abcdef0123456789abcdef0123" b', "en", "s", 1), (2, "clean text", "en", None, 1), (3, None, None, None, None)]
    got = {r.doc_id: r for r in S.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == 'a [secret]" b' and got[2].text == "clean text" and got[3].text is None and got[2].source is None
    q = {r.doc_id: r for r in S.op6_scan_secrets(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert set(q) == set(docs)
    for i, r in q.items():
        want = brute(docs[i])
        assert r.base_sha256 == hashlib.sha256(digest(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], DOCS + ", start long, kind string, _weak int, _row int, _key string, base_spans int")
    assert S.scan_secrets(docs).count() == 0 and S.redact(docs).columns == docs.columns
    one = spark.createDataFrame([(1, "username: alice Zx9" + "aB3d" * 10, "x", "s", 1, 7, "k", 3, 4, "y", 5)], docs.schema)
    assert S.scan_secrets(one, keep=["doc_id", "start", "kind"]).first().kind == "k"
    got = S.scan_secrets(one).first()
    assert (got._row, got._key, len(got.all_spans)) == (4, "y", 2) and S.redact(one).first().base_spans == 5


def test_opaque_values_after_any_name(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    token, url_safe = "Zx9" + "aB3d" * 9, "Ab3_dE-9" * 5
    texts = {
        1: f"AWS_ACCESS_KEY_ID=AKIA{'B7' * 8}\nAWS_SECRET_ACCESS_KEY={key}",
        2: f"https://svc.example/v1?key={token}",
        3: f"username: alice ghp_{token}",
        4: f"client_id: alice X_SIGNING={url_safe}==",
        5: f"X_SIGNING={key} alone",
    }
    hidden = {1: key, 2: token, 3: token, 4: url_safe}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    for r in S.scan_secrets(docs).collect():
        assert any(s.kind == 4 and hidden[r.doc_id] in r.text[s.start : s.end] for s in r.all_spans) if r.doc_id in hidden else not r.all_spans
    assert all(hidden.get(r.doc_id, "\0") not in r.text for r in S.redact(docs).collect())


WEAK = [(3, S.LOGIN), (4, S.STRONG_LOOKING), (5, S.ENDPOINT)]


def brute_linked(text, window):
    """All spans by comparing every weak part with every other part."""
    base = brute(text)
    weak = sorted((m.start(), k, m.end()) for k, p in WEAK for m in re.finditer(p, text or ""))
    role = ("secret", "name", "secret", "name", "secret", "place")
    meets = lambda a, b: (role[a[1]] == "secret") != (role[b[1]] == "secret") and b[0] <= a[2] + window and a[0] <= b[2] + window
    return sorted({*base, *(a for a in weak if any(meets(a, b) for b in base + weak))})


def brute_redacted(text, spans):
    out, at = [], -1
    for s, _, e in spans:
        if s > at:
            out += [text[max(at, 0) : s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[max(at, 0) :]


def some_texts(n, seed):
    r = random.Random(seed)
    parts = ["username: alice", "user=\U0001f600", "login:bob99", "client_id=ab-c", "https://svc.example:80/x?y=é", "redis://h", "token=abcdef", "AKIA" + "B" * 17, "f" * 30,
             "Zx9" + "aB3d" * 10, "password: 'hunter22'", "é" * 7, " ", "\n", "word " * 5, "word " * 30, "\U0001f600", "-" * 90]
    return [r.choice(("", " ")).join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_links_and_redaction_match_brute_force(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(some_texts(400, 7))] + [(0, "username: alice " + "Zx9" + "aB3d" * 10, "en", "s", 1)] * 50
    docs = spark.createDataFrame(rows, DOCS)
    linked = 0
    for r in S.scan_secrets(docs).collect():
        want = brute_linked(r.text, S.WINDOW)
        assert [tuple(s) for s in r.all_spans] == want, r.text
        linked += sum(k >= 3 for _, k, _ in want)
    assert linked > 500
    want = sorted(brute_redacted(t, brute_linked(t, S.WINDOW)) for _, t, *_ in rows)
    got = S.redact(docs, length="n_chars").collect()
    assert sorted(r.text for r in got) == want and all(r.n_chars == len(r.text) or r.n_chars == 1 for r in got)


def test_long_texts_are_linear(spark):
    text = "é token=abcdef0 " * 60_000
    docs = spark.createDataFrame([(1, text, "en", "s", 1)], DOCS)
    began = time.perf_counter()
    assert S.redact(docs).first().text == "é [secret] " * 60_000
    assert time.perf_counter() - began < 60
