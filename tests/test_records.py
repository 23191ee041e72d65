"""Scans, sinks, filters, dedup, splits and composition on hand-built rows."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import checks, contamination, dedup, filters, split
from millrace.plans import corpus, manifest, pipeline
from millrace.schema import INDEXED_RECORD, MESSAGES
from millrace.sources import jsonl


def record(index, turns, source="s", record_id="r", split_=None, language="python"):
    provenance = (source, "rev", ("mit", None, None), split_, record_id, None, {"k": "v"})
    return (index, 1, turns, language, provenance, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, INDEXED_RECORD)


UA = [("user", "q"), ("assistant", "a")]


def test_well_formed_and_reasons(spark):
    cases = [(UA, []), ([], ["malformed_record"]), ([("system", "s")], ["malformed_record"]), ([("system", "s"), *UA], []), ([("user", "a"), ("user", "b"), ("assistant", "c")], ["malformed_record"]),
             ([*UA, ("user", "x")], ["malformed_record"]), ([("user", " \u001c"), ("assistant", "　")], ["empty_prompt", "empty_response"]), ([("assistant", ""), ("user", "b")], ["malformed_record", "empty_response"])]
    df = filters.filter_content(frame(spark, [record(i, t) for i, (t, _) in enumerate(cases)]))
    assert [r.reasons for r in df.orderBy("input_index").collect()] == [c[1] for c in cases]
    counts = {r.reason: r.n for r in filters.reason_counts(df).collect()}
    assert counts == {"invalid_text_encoding": 0, "malformed_record": 5, "empty_prompt": 1, "empty_response": 2}


def test_validators_annotate(spark):
    df = filters.with_validation(frame(spark, [record(0, UA), record(1, UA, language="rust")]), {"language": filters.language_validator("python")})
    rows = df.orderBy("input_index").select("id_collision", filters.validation_passed().alias("p"), "validation").collect()
    assert [(r.id_collision, r.p) for r in rows] == [(False, True), (False, False)] and rows[1].validation.results[0].detail == "language=rust"
    again = filters.with_validation(df.drop("id_collision"), {"language": filters.language_validator("python")})
    assert all(r.id_collision for r in again.collect())


def test_length_bounds_count(spark):
    rows = [record(i, [("user", "w " * n), ("assistant", "")]) for i, n in enumerate((2, 3, 6, 7))]
    out = filters.filter_length(frame(spark, rows), 5, 8).orderBy("input_index").collect()
    assert [(r.token_count, r.length_reason) for r in out] == [(4, "too_short"), (5, None), (8, None), (9, "too_long")]


def test_dedup_and_violations(spark):
    rows = [record(3, UA, record_id="x"), record(1, [("user", "﻿q"), ("assistant", "a")], record_id="x"), record(2, UA, record_id=None), record(5, UA, source="t", record_id="x"), record(7, [("user", "z"), ("assistant", "a")], record_id=None)]
    out = {r.input_index: r for r in dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert {i for i, r in out.items() if r.retained} == {1, 7}
    assert (out[3].content_duplicate_of, out[3].source_duplicate_of, out[3].reasons) == (1, 1, dedup.REASONS)
    assert (out[5].content_duplicate_of, out[5].source_duplicate_of) == (1, None)
    hashed = dedup.with_identity(text.with_fingerprints(frame(spark, [*rows, record(9, [("user", "other"), ("assistant", "a")], record_id="x")])))
    assert [r.contents for r in dedup.identity_conflicts(hashed).collect()] == [2]
    assert dedup.hash_collisions(hashed).isEmpty()
    with pytest.raises(checks.InvariantError, match="conflict"):
        checks.assert_empty(dedup.identity_conflicts(hashed), "conflict")


def test_splits(spark):
    rows = [record(i, [("user", f"p{i % 12}"), ("assistant", f"a{i}")], record_id=str(i)) for i in range(60)]
    kept = text.with_fingerprints(frame(spark, rows))
    for order in ("native", "compat"):
        out = split.leakage_safe_split(kept, fraction=0.25, seed=3, order=order)
        assert out.where("partition = 'validation'").count() == 15 and out.count() == 60 and split.leaks(out).isEmpty()
    assert [split.validation_target(n, 0.05) for n in (2, 10, 30, 50, 70)] == [1, 1, 2, 2, 4]
    quotas = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, size long")
    assert {r.k: r.quota for r in split.quotas(quotas, 5, "k").collect()} == {"a": 3, "b": 1, "c": 1}
    tasks = spark.createDataFrame([("he", str(i)) for i in range(50)], "suite string, task_id string")
    rule = {"salt": "x", "modulus": 4, "development": [1]}
    parts = split.hash_partition(tasks, **rule)
    for r in parts.collect():
        want = int.from_bytes(hashlib.sha256(f"x\0he\0{r.task_id}".encode()).digest()[:8], "big") % 4
        assert r.remainder == want and (r.partition == "development") == (want == 1)
    assert split.frozen_membership_violations(parts, tasks, **rule).isEmpty()
    assert split.frozen_membership_violations(parts.limit(49), tasks, **rule).count() == 1


def test_contamination_threshold(spark):
    words = [f"w{i}" for i in range(24)]
    guard = spark.createDataFrame([("b", "1", [("user", " ".join(words))], " ".join(words))], f"protected_dataset_id string, protected_record_id string, prompt_messages {MESSAGES}, solution string")
    near, far = " ".join(words[:20]), " ".join(words[:12] + ["x"] + words[13:])
    rows = [record(0, [("user", " ".join(words)), ("assistant", "n")]), record(1, [("user", "u"), ("assistant", near)]), record(2, [("user", "u"), ("assistant", far)]), record(3, [("user", "v"), ("assistant", " ".join(words))])]
    hashed = text.with_fingerprints(frame(spark, rows))
    ids = {r.record_sha256: r.input_index for r in hashed.collect()}
    found = contamination.training_findings(hashed, guard)
    assert sorted((ids[r.training_record_sha256], r.finding_type, r.score) for r in found.collect()) == [(0, "exact_prompt_match", 1.0), (1, "high_solution_overlap", 1.0), (3, "exact_solution_match", 1.0)]
    assert contamination.status(None) == "not_run" and contamination.status(found) == "findings" and contamination.status(found.limit(0)) == "clean"
    at = contamination.training_findings(hashed, guard, threshold=0.75)
    assert (2, 0.75) in {(ids[r.training_record_sha256], r.score) for r in at.collect()}


def test_component_precedence(spark):
    long = " ".join(f"w{i}" for i in range(20))
    a = spark.createDataFrame([(1, "t\r\nx"), (2, "same"), (3, long + " more")], "component_id long, text string")
    b = spark.createDataFrame([(1, "t\nx"), (2, "same"), (3, long)], "reference_id long, text string")
    assert sorted((r.component_id, r.match) for r in contamination.component_collisions(a, b).collect()) == [(1, "normalized"), (2, "exact"), (3, "overlap")]


def test_composition_with_shortfall(spark):
    mk = lambda i, n, s: record(i, [("user", f"q{n}"), ("assistant", "a b c")], source=s, record_id=str(i))
    one = frame(spark, [mk(i, i, "one") for i in range(10)])
    two = frame(spark, [mk(0, 1, "two"), mk(1, 1, "two"), record(2, [("user", ""), ("assistant", "x")], source="two"), mk(3, 50, "two")])
    out = corpus.compose({"one": one, "two": two}, [corpus.Budget("one", 3), corpus.Budget("two", 4)], "one", least=3, most=50)
    stats = {r.source_id: r.asDict() for r in out.stats.collect()}
    assert (stats["two"]["scanned"], stats["two"]["accepted"], stats["two"]["duplicate_rejected"], stats["two"]["content_rejected"]) == (4, 2, 1, 1)
    # two short, asked of the filling source, which meets one copy of what the other accepted and stops after its sixth row
    assert (stats["one"]["requested"], stats["one"]["scanned"], stats["one"]["accepted"], stats["one"]["duplicate_rejected"]) == (5, 6, 5, 1)
    assert [(r.source_order, r.input_index) for r in out.accepted.orderBy("source_order", "input_index").collect()] == [(0, 0), (0, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 3)]
    assert {(r.stage, r.reason): r.n for r in corpus.rejection_counts(out).collect()} == {("content", "empty_prompt"): 1, ("duplicate", "duplicate_content"): 2}


def test_pipeline_and_manifest(spark):
    rows = [record(i, [("user", f"q{i % 5}"), ("assistant", f"a{i % 8}")], record_id=str(i)) for i in range(40)] + [record(40, [("user", ""), ("assistant", "x")], record_id="40")]
    stages = pipeline.prepare(frame(spark, rows), validators={"language": filters.language_validator("python")}, fraction=0.2)
    counts = pipeline.stage_counts(stages)
    assert counts.first().asDict() == {"input": 41, "content_rejected": 1, "length_rejected": 0, "duplicates": 0, "retained": 40, "conserved": True}
    checksum = manifest.content_checksum(stages.retained)
    hashes = [r.record_sha256 for r in stages.retained.orderBy("input_index").collect()]
    assert checksum.first().sha256 == hashlib.sha256(json.dumps(hashes, separators=(",", ":")).encode()).hexdigest()
    document = manifest.manifest(counts, manifest.source_summary(frame(spark, rows), stages.retained), checksum, "clean", 1729, 0.2)
    assert document["sources"][0]["prepared"] == 40 and manifest.preflight_problems(document, checksum) == []
    assert manifest.preflight_problems(document, manifest.content_checksum(stages.retained.limit(39))) == ["n", "sha256"]
    assert manifest.tree_checksum(stages.retained).first().n == 40


def test_jsonl_round_trip_and_strictness(spark, tmp_path):
    rows = [record(i, [("user", t), ("assistant", "a b \x1b")], record_id=str(i)) for i, t in enumerate(["q", "é\n☃", '"\\'])]
    df = frame(spark, rows)
    jsonl.write_records(df, str(tmp_path / "out"))
    back = jsonl.load_records(spark, str(tmp_path / "out"), "python")
    key = lambda d: sorted((r.messages[0].content, r.messages[1].content, r.provenance.record_id) for r in d.collect())
    assert key(back) == key(df)
    line = next(x for f in (tmp_path / "out").glob("part*") for x in f.read_text().split("\n") if x)
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    bad = tmp_path / "bad.jsonl"
    parsed = json.loads(line)
    lines = [line, "", "{", json.dumps(parsed | {"extra": 1}), json.dumps({k: v for k, v in parsed.items() if k != "language"}), json.dumps(parsed | {"schema_version": 2}), line.replace('"content":"', '"content":"\\ud800', 1)]
    bad.write_text("\n".join(lines) + "\n")
    scanned = jsonl.scan_records(spark, str(bad)).orderBy("input_index").collect()
    assert [r.problem for r in scanned] == [None, "blank_line", "bad_json", "unknown_key", "missing_key", "schema_version", None]
    assert [r.path for r in scanned] == [None, "", "", "extra", "language", "schema_version", None]
    assert [r.bad_encoding for r in scanned][-1] and not scanned[0].bad_encoding
    with pytest.raises(checks.InvariantError):
        jsonl.load_records(spark, str(bad), "python")
    with pytest.raises(checks.InvariantError):
        jsonl.load_records(spark, str(tmp_path / "out"), "rust")
    jsonl.write_records(df.withColumn("partition", F.when(F.col("input_index") < 1, "validation").otherwise("train")), str(tmp_path / "parts"), "partition")
    assert spark.read.text(str(tmp_path / "parts")).groupBy("partition").count().count() == 2


def test_benchmark_hub_and_results(spark, tmp_path):
    items = spark.createDataFrame([(0,), (1,), (1,), (3,)], "item_id long")
    assert sorted((r.item_id, r.side) for r in jsonl.benchmark_violations(items, 3).collect()) == [(1, "repeated"), (2, "missing"), (3, "unexpected")]
    spark.createDataFrame([(1, ("py",)), (2, ("rs",)), (0, ("py",))], "id long, metadata struct<extension:string>").write.parquet(str(tmp_path / "hub"))
    scan = jsonl.hub_scan(spark, str(tmp_path / "hub"), F.col("metadata.extension") == "py", {"input_index": F.col("id")}, limit=1)
    assert [r.input_index for r in scan.collect()] == [0]
    (tmp_path / "res.jsonl").write_text('{"problem_id":"a"}\n{"problem_id":"a"}\n')
    with pytest.raises(checks.InvariantError):
        jsonl.scan_results(spark, str(tmp_path / "res.jsonl"), "problem_id string")
    with pytest.raises(ValueError, match="x"):
        jsonl.protected_union({}, ["x"])


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "b.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ok.txt", "data")
        z.writestr("ok.txt.sha256", hashlib.sha256(b"data").hexdigest() + "  ok.txt\n")
        z.writestr("changed.txt", "data2")
        z.writestr("changed.txt.sha256", "00  changed.txt\n")
        z.writestr("alone.txt", "x")
        z.writestr("../evil.txt", "x")
    assert jsonl.bundle_problems(path) == [("../evil.txt", "unsafe_path"), ("alone.txt", "no_sidecar"), ("changed.txt", "digest_differs")]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"1")
    expected = spark.createDataFrame([("a.bin", hashlib.sha256(b"1").hexdigest()), ("b.bin", "00")], "name string, sha256 string")
    assert [r.name for r in jsonl.inventory_drift(spark, str(folder), expected).collect()] == ["b.bin"]
    digest = jsonl.write_document({"b": 1, "a": "é"}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json.sha256").read_text() == f"{digest}  m.json\n"


def test_shapes_name_the_first_fault(spark):
    from millrace.functions.shapes import Boolean, Integer, Items, Nullable, Object, Pair, Text, first_fault

    shape = Object(
        {"a": Items(Object({"b": Text(blank=False, most_bytes=4)}, {"c": Nullable(Items(Integer(0, 9)))}), least=1, most=2, key="$.b")},
        {"p": Items(Pair(), key="$[0]", ordered=True), "x": Boolean(), "t": Text(nullable=True, pattern="[ab]+", least=1, rules=(("no_b", lambda t: ~t.contains("b")),))},
    )
    cases = {
        '{"a":[{"b":"é"}]}': None, '{"a":[{"b":"é","c":[1,2]},{"b":"z","c":null}],"x":true,"t":null,"p":[["a","1"],["b","2"]]}': None,
        "": ("", "bad_json"), "[]": ("", "not_an_object"), "{}": ("a", "missing_key"), '{"a":[],"z":1,"y":2}': ("y", "unknown_key"), '{"a":{}}': ("a", "not_a_sequence"), '{"a":[]}': ("a", "too_few"),
        '{"a":[{"b":"x"},{"b":"y"},{"b":"z"}]}': ("a", "too_many"), '{"a":[{"b":"x"},{"b":"x"}]}': ("a", "repeated"), '{"a":[{"b":"x"},7]}': ("a[1]", "not_an_object"), '{"a":[{"b":"x","d":1}]}': ("a[0].d", "unknown_key"),
        '{"a":[{"b":1}]}': ("a[0].b", "not_a_string"), '{"a":[{"b":null}]}': ("a[0].b", "not_a_string"), '{"a":[{"b":"\u3000"}]}': ("a[0].b", "blank"), '{"a":[{"b":"ééé"}]}': ("a[0].b", "too_long"),
        '{"a":[{"b":"x","c":[1,-1]}]}': ("a[0].c[1]", "out_of_range"), '{"a":[{"b":"x","c":[1,10]}]}': ("a[0].c[1]", "out_of_range"), '{"a":[{"b":"x","c":[1.0]}]}': ("a[0].c[0]", "not_an_integer"), '{"a":[{"b":"x","c":[true]}]}': ("a[0].c[0]", "not_an_integer"),
        '{"a":[{"b":"x"}],"x":0}': ("x", "not_a_boolean"), '{"a":[{"b":"x"}],"t":1}': ("t", "not_a_string_or_null"), '{"a":[{"b":"x"}],"t":"c"}': ("t", "pattern"), '{"a":[{"b":"x"}],"t":""}': ("t", "empty"), '{"a":[{"b":"x"}],"t":"ab"}': ("t", "no_b"),
        '{"a":[{"b":"x"}],"p":[["a"]]}': ("p[0]", "not_two_strings"), '{"a":[{"b":"x"}],"p":[["a","b"],["a","c"]]}': ("p", "repeated"), '{"a":[{"b":"x"}],"p":[["b","1"],["a","2"]]}': ("p", "not_in_order"), '{"a":[{"b":"x"}],"p":[["b"," "]]}': ("p[0]", "blank"),
        '{"a":[{"b":"x"}],"a":1}': ("", "bad_json"),
    }
    out = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, j string").select("i", first_fault(F.col("j"), shape).alias("f")).orderBy("i").collect()
    assert [tuple(r.f) if r.f else None for r in out] == list(cases.values())


def test_source_metadata_is_written_as_pairs(spark, tmp_path):
    row = record(0, [("user", "q"), ("assistant", "a")], record_id="0")
    df = frame(spark, [row]).withColumn("provenance", F.col("provenance").withField("source_metadata", F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"))))
    jsonl.write_records(df, str(tmp_path / "pairs"))
    line = next(x for f in (tmp_path / "pairs").glob("part*") for x in f.read_text().split("\n") if x)
    assert json.loads(line)["provenance"]["source_metadata"] == [["a", "2"], ["z", "1"]]
    assert jsonl.load_records(spark, str(tmp_path / "pairs"), "python").first().provenance.source_metadata == {"a": "2", "z": "1"}
