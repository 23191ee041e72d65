"""Evaluation analytics, distillation, trajectories and streams on hand-built rows."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import distill, evaluation as ev, trajectory
from millrace.streaming import resume


def test_pass_at_1_is_null_under_harness_errors(spark):
    rows = [("a", "none", (2, 2)), ("a", "timeout", (2, 2)), ("b", "none", (1, 1)), ("b", "harness", (0, 1))]
    df = spark.createDataFrame(rows, "suite string, error_category string, tests struct<passed:int,total:int>")
    out = {r.suite: r for r in ev.pass_at_1(df, "suite").collect()}
    assert (out["a"].pass_at_1, out["a"].passed, out["a"].all_tests_passed) == (0.5, 1, 2) and out["b"].pass_at_1 is None


def test_exact_tail_and_gain():
    assert ev.sign_tail(0, 0) == 1.0 and ev.sign_tail(3, 0) == 0.125 and ev.sign_tail(5, 5) == pytest.approx(0.623046875)
    assert math.isclose(ev._log_tail(520, 490), sum(math.comb(1010, k) for k in range(520, 1011)) / 2**1010, rel_tol=1e-9)
    assert [ev.minimum_net_gain(m) for m in (1, 25)] == [5, 9]


def test_paired_effect(spark):
    rows = [(str(i), i >= 10, True) for i in range(12)] + [("x", False, False)]
    df = spark.createDataFrame(rows, "task_id string, base_passed boolean, candidate_passed boolean")
    r = ev.paired_effect(df, comparisons=2).first()
    assert (r.improvements, r.regressions, r.net_improvement, r.unchanged_fail, r.strong_evidence) == (10, 0, 10, 1, True)
    none = ev.paired_effect(df.where("task_id = 'x'"), comparisons=2).first()
    assert none.unadjusted_p_value == 1.0 and not none.strong_evidence
    assert ev.paired_membership_violations(df, df.limit(0)).count() == 13


def test_run_variance(spark):
    rows = [(1, "a", True), (1, "b", False), (2, "a", True), (2, "b", True), (3, "a", False), (3, "b", True)]
    df = spark.createDataFrame(rows, "run int, task_id string, passed boolean")
    r = ev.run_variance(df).first()
    assert (r.run_count, r.task_count, r.score_range, r.flips, r.unstable_tasks, r.flip_rate) == (3, 2, 1, 2, 2, 0.5)
    assert math.isclose(r.score_variance, 2 / 9) and ev.run_membership_violations(df.limit(5)).count() >= 1


def test_reproduction_selection_and_gates(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id int, f string, g int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 2), (4, "z", 1)], "id int, f string, g int")
    assert sorted((r.id, r.status, r.changed_fields) for r in ev.reproduction_diff(a, b, "id", ["f", "g"]).collect()) == [(2, "changed", "f,g"), (3, "missing", ""), (4, "unexpected", "")]
    scores = spark.createDataFrame([("a", 1e-5, 50, 100, True), ("b", 1e-6, 50, 100, True), ("c", 1e-6, 10, 120, False)], "label string, learning_rate double, step int, combined_passed int, eligible boolean")
    assert ev.select_candidate(scores).first().label == "b"
    evidence = spark.createDataFrame([(0.95, 0.5, "clean")], "stop_rate double, accept_rate double, contamination_status string")
    decision = ev.gate_decision(ev.gate(evidence, ev.study_gates())).first()
    assert (decision.passed, decision.failed_checks) == (False, "student_length_accept_rate_given_stop")
    cross = lambda rows: ev.cross_language_conclusion(spark.createDataFrame(rows, "language string, base_passed int, candidate_passed int, total int")).first()[0]
    assert [cross([("ts", 0, 0, 3)]), cross([("ts", 2, 0, 3), ("rs", 1, 1, 3)]), cross([("ts", 2, 1, 3)])] == ["inconclusive", "catastrophic", "none"]


def test_scoring(spark):
    rows = [("exact", "a", "a", True), ("json", '{"a":1,"b":[2]}', '{"b":[2],"a":1}', True), ("json", "{}", "no", False), ("tool_call", '{"n":1}', 'x <tool_call>{"n":1}</tool_call>', False), ("tool_call", '{"n":1}', '<tool_call>\n{"n": 1}\n</tool_call>', True), ("exact", "a", None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, expected string, response string, want boolean")
    assert all(r.got == r.want for r in df.select("want", ev.response_score(F.col("kind"), F.col("expected"), F.col("response")).alias("got")).collect())
    one = spark.createDataFrame([("PASS:1\nPASS:3\nPASS:3\nPASS:9\nxPASS:2",)], "e string")
    assert one.select(ev.marked_passes(F.col("e"), "PASS:", F.lit(4))).first()[0] == 2
    cases = [("Fn main\nend", 5, None), (" \n", 5, "empty response"), (None, 5, "empty response"), ("fn main", 20, "generation reached the token budget"), ("fn UNSAFE", 5, "forbidden pattern matched: unsafe"), ("main", 5, "missing required patterns: fn .*end")]
    scored = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n int").select("i", ev.structural_score(F.col("t"), F.col("n"), ["fn .*end"], ["unsafe"], 20).alias("s")).orderBy("i").collect()
    assert [r.s.reason for r in scored] == [c[2] for c in cases] and [r.s.passed for r in scored] == [c[2] is None for c in cases]
    kinds = spark.createDataFrame([("ok", 2, 2), ("ok", 1, 2), ("timeout", 0, 2), ("not_started", 0, 2), ("syntax_error", 0, 2), ("crash", 0, 2)], "s string, p int, t int")
    assert [r[0] for r in kinds.select(ev.outcome_category(F.col("s"), F.col("p"), F.col("t"))).collect()] == ["none", "assertion", "timeout", "harness", "syntax", "runtime"]


def test_distillation(spark):
    expected = spark.createDataFrame([(i, 2) for i in range(4)], "shard long, n long")
    payload = spark.createDataFrame([(0, 2, "a"), (1, 2, "b"), (2, 1, "c")], "shard long, n long, sha256 string")
    sidecar = spark.createDataFrame([(0, "a"), (1, "x"), (2, "c"), (3, "d")], "shard long, sha256 string")
    assert {r.shard: r.status for r in distill.shard_status(expected, payload, sidecar).collect()} == {0: "complete", 1: "corrupt", 2: "incomplete", 3: "error"}
    done = spark.createDataFrame([("<think>r</think>a", "stop"), ("a", "stop"), ("<think>r", "stop"), ("hidden thought", "length"), ("r</think>a", "stop")], "completion string, finish_reason string")
    got = distill.salvage(done).collect()
    assert [r["mode"] for r in got] == ["wrapped", "refused", "refused", "truncated-reasoning-only", "closing-only"]
    assert [(r.reasoning, r.answer) for r in got] == [("r", "a"), (None, None), (None, None), ("hidden thought", ""), ("r", "a")]
    rows = spark.createDataFrame([("stop", 3000, 2000, 1500), ("stop", 3000, 1000, 1500), ("length", 3000, 2000, 1500)], "finish_reason string, full_tokens int, answer_tokens int, budget int")
    assert distill.compression_targets(rows).count() == 1 and distill.compression_violations(rows).count() == 1
    source = spark.createDataFrame([(0, [("user", "q"), ("assistant", "old")], "r0", "p0"), (1, [("user", "q"), ("assistant", "old")], "r1", "p1"), (2, [("user", "q"), ("assistant", "old")], "r2", "p2")], "input_index long, messages array<struct<role:string,content:string>>, record_sha256 string, prompt_sha256 string")
    shards = spark.createDataFrame([(0, "r0", "p0", "new", "stop"), (1, "zz", "p1", "new", "stop")], "input_index long, input_record_sha256 string, prompt_sha256 string, final_response string, finish_reason string")
    out = {r.input_index: r for r in distill.reconstruct(source, shards).collect()}
    assert out[0].messages[-1].content == "new" and [out[i].problem for i in range(3)] == [None, "drift", "missing"]


def test_ledger_and_alignment(spark):
    rows = [("s", 0, [1, 2], [3]), ("s", 1, [1, 2, 3, 4], [5]), ("t", 0, [1], [2]), ("t", 1, [9, 2, 3], [4])]
    turns = spark.createDataFrame(rows, "session_id string, turn_index int, prompt_ids array<int>, output_ids array<int>")
    out = {(r.session_id, r.turn_index): r for r in trajectory.ledger(turns).collect()}
    assert out["s", 1].appended_ids == [4] and out["s", 1].problem is None and out["t", 1].problem == "prefix_changed"
    good = trajectory.ledger(turns.where("session_id = 's'")).withColumn("log_probs", F.transform("output_ids", lambda _: F.lit(-0.5)))
    a = trajectory.bind_rewards(trajectory.align(good), spark.createDataFrame([("s", 1.0)], "session_id string, reward double")).first()
    assert (a.input_ids, a.action_ids, a.action_mask, a.log_prob_sum, a.problem) == ([1, 2, 3, 4, 5], [3, 5], [False, False, True, False, True], -1.0, None)
    segments = spark.createDataFrame([([1, 2], [("a", 0, 1), ("b", 1, 2)]), ([1, 2], [("a", 0, 1)])], "appended_ids array<int>, segments array<struct<kind:string,start:int,end:int>>")
    assert trajectory.segment_violations(segments).count() == 1


def test_stream_resumes_and_guards_identity(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"k":1}\n{"k":2}\n')
    run = lambda identity: resume.ingest(spark, str(source), "k long", folder, lambda b: b.withColumn("d", F.col("k") * 2), identity=identity)
    assert run("v1") == 1 and run("v1") == 0
    (source / "b.json").write_text('{"k":3}\n')
    assert run("v1") == 1 and sorted(r.d for r in resume.ingested(spark, folder).collect()) == [2, 4, 6]
    with pytest.raises(resume.RunIdentityError):
        run("v2")
    made = resume.generate(spark.createDataFrame([(1, "p"), (2, "q")], "item_id long, prompt string"), lambda prompts, seeds: [f"{p}{s}" for p, s in zip(prompts, seeds, strict=True)], seed=5)
    assert sorted(r.response for r in made.collect()) == ["p6", "q7"]
