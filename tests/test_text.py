"""Text, JSON and array expressions against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import code, text
from millrace.schema import MESSAGES

TEXTS = ["", "plain", "﻿bom", "﻿﻿double", "a\r\nb\rc\n", "tab\t\"quote\" \\ back", "control \x0b\x1b\x00\x1f", "snow ☃ é 𝄞", "  line \u0085 next", "\u001c   　"]


def normal(t):
    t = t[1:] if t.startswith("﻿") else t
    return t.replace("\r\n", "\n").replace("\r", "\n")


def digest(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_normalisation_and_blank(rows):
    assert values(rows, text.normalize_text(F.col("t"))) == [normal(t) for t in TEXTS]
    assert values(rows, text.is_blank(F.col("t"))) == [not t.strip() for t in TEXTS]
    assert values(rows, text.strip(F.col("t"))) == [t.strip() for t in TEXTS]


def test_json_and_fingerprints(rows, spark):
    assert values(rows, text.json_string(F.col("t"))) == [json.dumps(t, ensure_ascii=False) for t in TEXTS]
    records = rows.select("i", text.single_turn(F.col("t"), F.reverse("t")).alias("messages"))
    out = {r.i: r for r in text.with_fingerprints(records).collect()}
    for i, t in enumerate(TEXTS):
        p = digest({"schema_version": 1, "messages": [{"role": "user", "content": normal(t)}]})
        a = digest({"schema_version": 1, "role": "assistant", "content": normal(t[::-1])})
        assert (out[i].prompt_sha256, out[i].response_sha256) == (p, a)
        assert out[i].record_sha256 == digest({"schema_version": 1, "prompt_sha256": p, "response_sha256": a})
    hashes = spark.range(1).select(text.hash_list_sha256(F.array(F.lit("ab"), F.lit("cd"))).alias("h")).first().h
    assert hashes == hashlib.sha256(b'["ab","cd"]').hexdigest()


def test_single_turn_leaves_out_a_null_system(rows):
    system = F.when(F.col("i") == 0, "s")
    out = values(rows, text.single_turn(F.lit("u"), F.lit("a"), system))
    assert [m.role for m in out[0]] == ["system", "user", "assistant"] and [m.role for m in out[1]] == ["user", "assistant"]


def test_shingles_gate_and_score(spark):
    words = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(0, " ".join(words[:15])), (1, " ".join(words[:16])), (2, " ".join(words[:16]) + " " + " ".join(words[:16])), (3, None)], "i int, t string")
    out = text.with_shingles(df, F.col("t"), "s")
    assert values(out, F.size("s")) == [0, 12, 16, 0]
    pair = out.where("i = 1").select(F.col("s").alias("a")).crossJoin(out.where("i = 2").select(F.col("s").alias("b")))
    assert pair.select(text.overlap_score(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_reasoning(spark):
    cases = {
        "<think>a</think>b": ("a", "b", False), "a</think>b": ("a", "b", False), "<think>a": (None, None, True), "a<think>b</think>c": (None, None, True), "plain": (None, "plain", False),
        "<think>a</think>": (None, None, True), "<think></think>b": (None, "b", False), "<think>a</think>b</think>": (None, None, True), "x<think>": (None, None, True), "": (None, "", False),
        " <think> a </think> b ": ("a", "b", False),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.split_reasoning(F.col("t")).alias("s"))
    for r in df.collect():
        assert (r.s.reasoning, r.s.answer, r.s.error is not None) == cases[r.t], r


def test_completions(spark):
    df = spark.createDataFrame([("say\n```python\nx = 1\n```\nend", "say", 0), ("echo: rest # stop def", "echo: ", 1)], "t string, p string, i int")
    assert values(df, text.first_fence(F.col("t"))) == ["x = 1\n", "echo: rest # stop def"]
    assert values(df, text.without_echo(F.col("t"), F.col("p")))[1] == "rest # stop def"
    assert values(df, text.until_stop(F.col("t"), ["def", "#"]))[1] == "echo: rest "


def test_policies(spark):
    df = spark.createDataFrame([(0, [("system", "be"), ("user", "q")]), (1, [("user", "q"), ("assistant", "a")])], f"i int, messages {MESSAGES}")
    df = df.withColumn("w", text.inject_policy(F.col("messages"), F.lit("P")))
    assert [m.content for m in values(df, "w")[0]] == ["be\n\nP", "q"] and [m.role for m in values(df, "w")[1]] == ["system", "user", "assistant"]
    assert values(df, text.strip_policy(F.col("w"), F.lit("P"))) == values(df, "messages")
    assert values(df, text.strip_policy(F.col("w"), F.lit("Q"))) == [None, None]
    n = spark.createDataFrame([(0, 10), (1, 500), (2, 1920)], "i int, n int")
    assert values(n, text.answer_budget(F.col("n"))) == [1792, 1420, None]


def test_masks_and_truncation(spark):
    df = spark.createDataFrame([(0, [True, True, False, True]), (1, []), (2, [False])], "i int, m array<boolean>")
    assert [[tuple(s) for s in v] for v in values(df, text.true_runs(F.col("m")))] == [[(0, 2), (3, 4)], [], []]
    ids = spark.createDataFrame([(0, [1, 2, 3], [1, 2]), (1, [1, 2], [2]), (2, [1], [1, 2])], "i int, f array<int>, p array<int>")
    assert values(ids, text.completion_mask(F.col("f"), F.col("p"))) == [[False, False, True], None, None]
    t = spark.createDataFrame([(0, "é" * 10), (1, "𝄞" * 5), (2, "short"), (3, "abcdefghijklmnop")], "i int, t string")
    got = values(t, text.truncate_utf8(F.col("t"), 12, "..."))
    assert got == ["éééé...", "𝄞𝄞...", "short", "abcdefghi..."]


def test_python_quality(spark):
    cases = {
        "x = 1": "validated_standalone_python", "def f(:\n  pass": "syntax_error", "print 'a'": "python2_print_statement", "print  (x)": "python2_print_statement", "print(x)": "validated_standalone_python",
        "just prose here": "not_applicable_non_standalone", "```\nx\n```": "not_applicable_unlabeled_fence", "```js\nx\n```": "not_applicable_non_python_fence", "a ```x``` b": "not_applicable_mixed_content",
        "```python\nx = 1\n```": "validated_standalone_python", "return x": "not_applicable_fragment", "  x = 1": "not_applicable_fragment", "diff --git a b": "not_applicable_diff", "#!/usr/bin/env python\nx = 1": "validated_standalone_python", "#!/usr/bin/env python\nHello there world": "not_applicable_non_standalone", "\n\tdiff --git a b": "not_applicable_diff",
        "import os\nraise E, 'x'": "python2_raise_syntax", "x = 10L": "python2_long_literal", "import a\nif a <> b: pass": "python2_not_equal",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    q = code.python_quality(F.lit("python"), F.lit(None).cast("array<string>"), F.col("t"))
    for r in df.select("t", q.alias("q")).collect():
        assert r.q.detail.split(";")[0] == f"reason={cases[r.t]}", r
        assert r.q.passed == cases[r.t].startswith(("valid", "not_"))
    other = df.limit(1).select(code.python_quality(F.lit("rust"), F.lit(None).cast("array<string>"), F.col("t")).alias("a"), code.python_quality(F.lit("python"), F.array(F.lit(None), F.lit(" Py2\t")), F.col("t")).alias("b")).first()
    assert other.a.detail == "reason=wrong_language" and other.b.detail == "reason=python2_source_metadata"


def test_contracts(spark):
    good = "\n".join(f"assert f({i}) == {i}" for i in range(8))
    cases = [("f", "def f(x): return x", good, "static_valid"), ("f", "def g(x): return x", good, "reference_missing_entry_point"), ("f", "def f(x): return x", "def f(): pass", "tests_redefine_entry_point"),
             ("f", "def f(x): return x", "f = 1", "tests_rebind_entry_point"), ("f", "def f(x): return x", "assert f(1)", "too_few_entry_point_assertions:1"), ("f", "import os\ndef f(x): return x", good, "forbidden_import:os"),
             ("f", "def f(:", good, "syntax_error:1"), (None, None, None, "unverifiable")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, e string, r string, t string")
    assert [v.reason for v in values(df, code.contract_check("e", "r", "t"))] == [c[3] for c in cases]
    blocks = spark.createDataFrame([(0, "```python\ndef f(): pass\n```\n```python\ndef g(): pass\n```", "f"), (1, "def f(): pass", "f"), (2, "def g(): pass", "f"), (3, "```\ndef f(): pass\n```", "f")], "i int, c string, e string")
    assert values(blocks, code.candidate_block("c", "e")) == ["def f(): pass", "def f(): pass", None, None]
    whole = {"schema_version": 1, "verifiable": True, "entry_point": "f", "reference_solution": "x", "tests": "y", "reason": "z"}
    none = whole | {"verifiable": False, "entry_point": None, "reference_solution": None, "tests": None}
    wanted = [
        (whole, "ok"), (none, "ok"), ("<think>r</think> " + json.dumps(whole), "ok"), ("r</think>" + json.dumps(none), "ok"), ("<think>" + json.dumps(whole), "unclosed_reasoning"), ("{", "bad_json"), ("[1]", "bad_json"), (None, "bad_json"),
        ({k: v for k, v in whole.items() if k != "schema_version"}, "keys"), (whole | {"more": 1}, "keys"), (whole | {"schema_version": 2}, "schema_version"), (whole | {"schema_version": "1"}, "schema_version"),
        (whole | {"verifiable": "true"}, "verifiable"), (whole | {"reason": " \n"}, "reason"), (whole | {"reason": 3}, "reason"), (none | {"tests": "y"}, "unverifiable_with_fields"),
        (whole | {"entry_point": "1f"}, "entry_point"), (whole | {"entry_point": None}, "entry_point"), (whole | {"entry_point": "größe_2"}, "ok"), (whole | {"reference_solution": ""}, "reference_solution"), (whole | {"tests": [1]}, "tests"),
    ]
    raw = spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, (t, _) in enumerate(wanted)], "i int, t string")
    assert values(raw, code.parse_contract(F.col("t"))["status"]) == [w for _, w in wanted]
    banned = spark.createDataFrame([(i, "f", f"import {m}\ndef f(x): return x" if m.isidentifier() else f"def f(x): return {m}", good) for i, m in enumerate(("time", "random", "secrets", "tempfile", "breakpoint()", "globals()"))], "i int, e string, r string, t string")
    assert [v.reason for v in values(banned, code.contract_check("e", "r", "t"))] == [*[f"forbidden_import:{m}" for m in ("time", "random", "secrets", "tempfile")], "forbidden_call:breakpoint", "static_valid"]
    calls = spark.createDataFrame([(0, '{"name":"run","arguments":{"cmd":"x"}}'), (1, '{"name":"run","arguments":{}}'), (2, '{"name":"no","arguments":{}}'), (3, '{"name":"run"}'), (4, "x")], "i int, t string")
    assert values(calls, code.parse_tool_call(F.col("t"), {"run": ["cmd"]})["status"]) == ["ok", "arguments", "unknown_tool", "keys", "bad_json"]


def test_typed_tool_calls(spark):
    from millrace.functions.tools import parse_typed_call

    cases = {
        '{"tool":"read","arguments":{"path":"a/b.py"}}': ("read", '{"arguments":{"max_lines":200,"path":"a/b.py","start_line":1},"tool":"read"}', None, None),
        '{"arguments":{"max_lines":2000,"start_line":7,"path":"..a/.b"},"tool":"read"}': ("read", '{"arguments":{"max_lines":2000,"path":"..a/.b","start_line":7},"tool":"read"}', None, None),
        '{"tool":"write","arguments":{"path":"é","content":"a\\n\\"b"}}': ("write", '{"arguments":{"content":"a\\n\\"b","path":"é"},"tool":"write"}', None, None),
        '{"tool":"bash","arguments":{"command":"ls"}}': ("bash", '{"arguments":{"command":"ls"},"tool":"bash"}', None, None),
        "{": (None, None, "", "bad_json"), "[1]": (None, None, "", "not_an_object"), '{"tool":"read"}': ("read", None, "arguments", "missing_key"), '{"tool":"read","arguments":{},"x":1}': ("read", None, "x", "unknown_key"),
        '{"tool":1,"arguments":{}}': (None, None, "tool", "not_a_string"), '{"tool":"fly","arguments":{}}': ("fly", None, "tool", "unknown_tool"), '{"tool":"glob","arguments":{"pattern":"*"}}': ("glob", None, "tool", "disabled_tool"),
        '{"tool":"read","arguments":[]}': ("read", None, "arguments", "not_an_object"), '{"tool":"read","arguments":{}}': ("read", None, "arguments.path", "missing_key"), '{"tool":"read","arguments":{"path":"a","lines":1}}': ("read", None, "arguments.lines", "unknown_key"),
        '{"tool":"read","arguments":{"path":"a","start_line":0}}': ("read", None, "arguments.start_line", "out_of_range"), '{"tool":"read","arguments":{"path":"a","start_line":"1"}}': ("read", None, "arguments.start_line", "not_an_integer"),
        '{"tool":"read","arguments":{"path":"a","max_lines":2001}}': ("read", None, "arguments.max_lines", "out_of_range"), '{"tool":"read","arguments":{"path":"a","max_lines":true}}': ("read", None, "arguments.max_lines", "not_an_integer"),
        '{"tool":"bash","arguments":{"command":" \\t"}}': ("bash", None, "arguments.command", "blank"), '{"tool":"bash","arguments":{"command":"a\\u0000"}}': ("bash", None, "arguments.command", "nul"),
        **{f'{{"tool":"read","arguments":{{"path":"{p}"}}}}': ("read", None, "arguments.path", r) for p, r in (
            ("", "not_posix_text"), (" ", "not_posix_text"), ("a\\\\b", "not_posix_text"), ("/a", "not_normalized"), ("a//b", "not_normalized"), ("a/", "not_normalized"), ("./a", "not_normalized"), ("a/../b", "not_normalized"),
            ("..", "not_normalized"), (".", "not_normalized"), ("grader/x", "reserved"), ("reference", "reserved"))},
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [tuple(r.c) for r in df.select("i", parse_typed_call(F.col("t"), "self_contained_v0").alias("c")).orderBy("i").collect()]
    assert got == list(cases.values())
    edits = {'{"tool":"edit","arguments":{"path":"a","old_text":"x","new_text":""}}': None, '{"tool":"edit","arguments":{"path":"a","old_text":"","new_text":""}}': "empty", '{"tool":"edit","arguments":{"path":"a","old_text":"x","new_text":"","expected_replacements":101}}': "out_of_range", '{"tool":"glob","arguments":{"pattern":"**/*.py"}}': None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(edits)], "i int, t string")
    assert [r.c.reason for r in df.select("i", parse_typed_call(F.col("t")).alias("c")).orderBy("i").collect()] == list(edits.values())


def test_policies_verify_what_they_take_out(spark):
    from millrace.functions import policies

    plain, budgeted = policies.Policy("concise", "Be brief."), policies.Policy("budgeted", "At most {answer_budget} tokens.", policies.Budget())
    rows = [([("user", "q"), ("assistant", "a")], 40), ([("system", "s \n"), ("user", "q"), ("assistant", "a")], 1900), ([("user", "q")], 1), ([("user", "q"), ("assistant", "a")], 1920), ([("assistant", "x"), ("assistant", "a")], 3), ([("user", "q"), ("assistant", "a")], 0)]
    df = spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(rows)], "i int, messages array<struct<role:string,content:string>>, n long").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    done = {k: df.withColumn("p", policies.apply_policy(F.col("messages"), F.col("metadata"), k, F.col("n"))).orderBy("i") for k in (plain, budgeted)}
    got = {k: [(r.p.problem, r.p.messages[0].content) for r in d.collect()] for k, d in done.items()}
    assert got[plain] == [(None, "Be brief."), (None, "s\n\nBe brief."), ("no_answer", "q"), (None, "Be brief."), ("no_user_message", "x"), (None, "Be brief.")]
    assert got[budgeted] == [(None, "At most 1792 tokens."), (None, "s\n\nAt most 20 tokens."), ("no_answer", "q"), ("no_budget", "q"), ("no_user_message", "x"), ("prompt_tokens", "q")]
    marked = done[budgeted].where("i = 1").select("p.messages", "p.metadata")
    again = marked.select(policies.apply_policy(F.col("messages"), F.col("metadata"), budgeted, F.lit(5)).alias("p")).first().p
    assert again.problem == "policy_present"

    def stripped(changes=None, messages=None, known=(plain, budgeted)):
        metadata = F.col("metadata") if changes is None else text.metadata_update(F.col("metadata"), {k: F.lit(v) for k, v in changes.items()})
        m = F.col("messages") if messages is None else F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in messages])
        out = marked.select(policies.strip_policies(m, metadata, list(known)).alias("s")).first().s
        return out.problem or out.messages[0].content

    assert stripped() == "s" and stripped(known=(plain,)) == "unknown_policy"
    assert stripped({policies.POLICY: None, policies.DIGEST: None}) == "s\n\nAt most 20 tokens." and stripped({policies.DIGEST: None}) == "incomplete_policy"
    assert stripped({policies.DIGEST: "0"}) == "policy_digest" and stripped({policies.POLICY: "concise"}) == "policy_digest"
    assert stripped({policies.BUDGET: "21"}) == "policy_budget" and stripped({policies.BUDGET: "x"}) == "policy_numbers" and stripped({policies.RESERVE: "1"}) == "policy_reserve"
    assert stripped({policies.WINDOW: "1"}) == "policy_window" and stripped({policies.CEILING: "1"}) == "policy_ceiling" and stripped({policies.PROMPT_TOKENS: None}) == "policy_numbers"
    assert stripped(messages=[("user", "q"), ("assistant", "a")]) == "no_system_message" and stripped(messages=[("system", "else"), ("assistant", "a")]) == "policy_text"
    assert stripped(messages=[("system", "\n\nAt most 20 tokens."), ("assistant", "a")]) == "empty_system_message" and stripped(messages=[("system", "At most 20 tokens.")]) == "no_answer"
    assert stripped(messages=[("system", "At most 20 tokens."), ("user", "q"), ("assistant", "a")]) == "q"
