import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import secret_scan as ss
from millrace.llm.queries import queries

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12 and m[1].isascii()]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(base)]


PIECES = ["password", "PassWord", "api_key", "APIKEY", "toKen", "secret", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef", "x", " ", "é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "https://u:p@h", "xoxb-123456789012"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_every_match_satisfies_its_query(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    for rule in ss.RULES:
        query = ss.trigram_query(rule.pattern)
        if re.search(rule.pattern, text):
            assert any(all(t in folded for t in clause) for clause in query), rule.name
    found = ss.spans_of(text, [(r, ss._compiled(r)) for r in ss.BASE])
    assert [f"{k}:{a}:{b}" for k, a, b in found] == brute(text)


def test_queries():
    assert ss.trigram_query("abcd|xyz") == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
    assert ss.trigram_query("a[bc]d?e") == ss.trigram_query("(ab|ac)(d|)e")
    assert ss.trigram_query("(?:foo)+bar.*bazz") == {frozenset({"foo", "bar", "baz", "azz"})}
    assert ss.trigram_query("a.c|[0-9]+") == ss.ANY == ss.trigram_query("(abc)?x")


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries()["op1_secrets"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) > 10
    for d in docs:
        spans, r = brute(d.text), rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == spans
        assert r.n_hex == sum(s.startswith("hex") for s in spans)


def test_edge_rows_and_redaction(spark):
    long = "x " * 60000 + "password = abcdefghijkl123"
    docs = [(None, None, 0), (None, "token: 0123456789abcdef", 23), (1, "", 0), (2, long, len(long)), (2, "no secrets", 10), (2, "no secrets", 10)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, n_chars long, rules string")
    out = ss.redact(df)
    assert out.columns == df.columns
    rows = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in out.collect())
    assert rows == sorted([("None", "None", 0), ("None", "[SECRET]", 8), ("1", "", 0), ("2", "x " * 60000 + "[SECRET]", 120008), ("2", "no secrets", 10), ("2", "no secrets", 10)])
    assert len(ss.scan(df).collect()) == 6 and ss.scan(df.limit(0)).collect() == []


def test_rules_beyond_ascii_and_beyond_one_class(spark):
    rules = (ss.Rule("umlaut", "größe_[a-z]+"), ss.Rule("fold", "(?i)kiste_token"), ss.Rule("two", "[a-z]_[0-9]+", 0, 8))
    texts = ["die größe_abc", "KISTE_TOKEN", "a_123456 a_1", "Kiste_Token", "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.spans] for r in ss.scan(df, rules).collect()}
    assert got == {0: [("umlaut", 4, 13)], 1: [("fold", 0, 11)], 2: [("two", 0, 8)], 3: [("fold", 0, 11)], 4: []}
