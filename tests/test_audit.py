"""Bundles, checkpoints, digest trees, ordered sinks, overlap joins and environment findings on hand-built rows."""

import hashlib
import random
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace import work
from millrace.functions.text import overlap_tokens, with_fingerprints
from millrace.operators import checks, contamination, dedup, distill, evaluation
from millrace.plans import merkle
from millrace.sources import bundles, jsonl
from millrace.streaming import checkpoint

from .test_records import frame, record

sha = lambda b: hashlib.sha256(b).hexdigest()


def test_overlap_pairs_against_brute_force(spark):
    rng = random.Random(4)
    common = list(range(900, 915))  # shingles that most sets have

    def made(n):
        out = {}
        for i in range(n):
            own = set(rng.sample(range(120), rng.choice([0, 3, 10, 25, 40]))) | set(rng.sample(common, rng.choice([0, 5, 15])))
            out[i] = own
        out[n], out[n + 1] = set(common), set(range(10, 20))
        return out

    left, right = made(60), made(25)
    for i in range(0, 60, 4):  # near copies of a right set, above and below the threshold
        base = sorted(right[i % 25])
        left[i] = set(base[: int(len(base) * rng.choice([0.7, 0.8, 0.9, 1]))]) | set(range(2000, 2000 + rng.choice([0, 1, 30])))
    want = {(a, b): len(x & y) / min(len(x), len(y)) for a, x in left.items() for b, y in right.items() if x and y}
    for threshold in (0.8, 0.5, 1.0):
        frames = [spark.createDataFrame([(i, sorted(s)) for i, s in d.items()], f"{n} long, shingles array<long>") for d, n in ((left, "lid"), (right, "rid"))]
        got = {(r.lid, r.rid): r.raw for r in contamination.overlap_pairs(frames[0].unionAll(frames[0].limit(5)), frames[1], threshold).collect()}
        assert got == {k: v for k, v in want.items() if v >= threshold}


def test_a_common_shingle_makes_no_candidates(spark):
    """All sets share five shingles; each has twenty of its own, so nothing but the common ones could meet."""
    sets = spark.range(2000).select(F.col("id").alias("lid"), F.expr("concat(sequence(0L, 4L), transform(sequence(1L, 20L), i -> 100 + id * 20 + i))").alias("shingles"))
    out = contamination.overlap_pairs(sets, sets.withColumnRenamed("lid", "rid"), 0.8)
    assert out.where("lid <> rid").isEmpty() and out.count() == 2000
    assert contamination.overlap_pairs(sets.limit(0), sets.withColumnRenamed("lid", "rid")).isEmpty()
    assert contamination.overlap_pairs(sets, sets.withColumnRenamed("lid", "rid").limit(0)).isEmpty()


def test_cross_partition_tells_every_entry_and_link(spark):
    rows = [("a1", "dev", "x"), ("a2", "dev", "x"), ("b1", "train", "x"), ("b2", "train", "x"), ("b3", "train", "x"), ("c1", "other", "x"), ("d", "dev", "alone"), ("e1", "dev", "y\r\n"), ("e2", "train", "y\n"), ("n1", "dev", None), ("n2", "train", None)]
    found = contamination.cross_partition_collisions(spark.createDataFrame(rows, "entry_id string, role string, text string")).collect()
    pairs = sum(x[1] != y[1] and (x[2] or "").replace("\r", "") == (y[2] or "").replace("\r", "") and x[2] is not None for x in rows for y in rows)
    assert sum(r.links for r in found) == pairs == 24
    assert {(r.left_id, r.right_id, r.class_id, r.links) for r in found if r.left_id in ("a2", "c1", "e2")} == {("a2", "b1", "a1", 3), ("a2", "c1", "a1", 1), ("c1", "a1", "a1", 2), ("c1", "b1", "a1", 3), ("e2", "e1", "e1", 1)}


WORDS = " ".join(f"w{i}" for i in range(30))
SCHEMA = "entry_id string, kind string, role string, task_id string, environment_id long, component_id string, text string"


def test_environment_findings(spark):
    train, dev, qual = "training_curriculum", "development_evaluation", "qualification_evaluation"
    rows = [
        ("a", "candidate", dev, "t1", 1, "specification", WORDS), ("a", "candidate", dev, "t1", 1, "tests", "plain\ntext"), ("b", "partition", train, "t1", 1, "specification", WORDS),
        ("c", "partition", train, "t3", 1, "specification", "plain\r\ntext"), ("d", "author", "author_few_shot", "t3", None, "specification", WORDS + " tail"), ("e", "partition", qual, None, None, "specification", "of its own"),
        ("f", "partition", "made_up", "t9", None, "specification", "other"), ("g", "partition", train, "h1", None, "specification", None),
    ]
    guard = spark.createDataFrame([("hb", "h1", "prompt", "of its own"), ("hb", "h2", "prompt", "plain\rtext"), ("hb", "h2", "solution", WORDS + " more")], "benchmark_id string, record_id string, component_id string, text string")
    got = {tuple(r)[:5]: r.score for r in contamination.environment_findings(spark.createDataFrame(rows, SCHEMA), guard).collect()}
    near = round(26 / 26, 6)
    want = {
        ("partition-overlap", "exact-task-id", "g", None, "hb/h1"): None, ("partition-overlap", "exact-content", "e", "specification", "hb/h1/prompt"): 1.0,
        ("normalized-content", "normalized-content", "a", "tests", "hb/h2/prompt"): 1.0, ("partition-overlap", "normalized-content", "c", "specification", "hb/h2/prompt"): 1.0,
        ("text-overlap", "text-overlap", "a", "specification", "hb/h2/solution"): near, ("partition-overlap", "text-overlap", "b", "specification", "hb/h2/solution"): near,
        ("author-few-shot", "text-overlap", "d", "specification", "hb/h2/solution"): round(26 / 27, 6),
        ("partition-overlap", "exact-task-id", "a", None, "b"): None, ("partition-overlap", "exact-task-id", "b", None, "a"): None,
        ("partition-overlap", "environment-role-conflict", "a", None, "b"): None, ("partition-overlap", "environment-role-conflict", "b", None, "a"): None, ("partition-overlap", "environment-role-conflict", "c", None, "a"): None,
        ("partition-overlap", "environment-task-conflict", "b", None, "c"): None, ("partition-overlap", "environment-task-conflict", "c", None, "b"): None,
        ("partition-overlap", "exact-content", "a", "specification", "b"): 1.0, ("partition-overlap", "exact-content", "b", "specification", "a"): 1.0,
        ("partition-overlap", "normalized-content", "a", "tests", "c"): 1.0, ("partition-overlap", "normalized-content", "c", "specification", "a"): 1.0,
        # the demonstration overlaps what is evaluated; that it overlaps training is no finding, and it is no subject itself
        ("partition-overlap", "text-overlap", "a", "specification", "d"): near, ("partition-overlap", "unknown-role", "f", None, None): None,
    }
    assert got == want
    ordered = contamination.in_order(contamination.environment_findings(spark.createDataFrame(rows, SCHEMA), guard)).orderBy("place").collect()
    assert [r.place for r in ordered] == list(range(len(want))) and [tuple(r)[:5] for r in ordered] == sorted(want, key=lambda k: tuple((v is not None, v or "") for v in k))


def test_bundles(spark, tmp_path):
    made = {"ok.txt": b"1", "ok.txt.sha256": f"{sha(b'1')}  ok.txt\n".encode(), "dir/a.jsonl": b'{"x":1}\n{"x":2}\n', "dir/a.jsonl.sha256": f"{sha(b'other')}  a.jsonl\n".encode(), "/abs": b"", "a/../b": b"", "x.sha256": b"none"}
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for name, data in made.items():
            z.writestr(name, data)
        link = zipfile.ZipInfo("ln")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "ok.txt")
        with pytest.warns(UserWarning):
            z.writestr("ok.txt", b"2")
        z.mkdir("folder")
    data = bytearray((tmp_path / "one.zip").read_bytes())
    got = {r.name: r.problem for r in bundles.bundle_findings(bundles.read_bundles(spark, str(tmp_path))).collect()}
    assert got == {"ok.txt": "repeated_path", "dir/a.jsonl": "digest_differs", "/abs": "unsafe_path", "a/../b": "unsafe_path", "ln": "link", "x.sha256": "missing_payload"}
    lines = bundles.read_bundles(spark, str(tmp_path), ".jsonl").orderBy("line_number").collect()
    assert [(r.bundle, r.name, r.line_number, r.line) for r in lines] == [("one.zip", "dir/a.jsonl", 1, '{"x":1}'), ("one.zip", "dir/a.jsonl", 2, '{"x":2}')]
    at = data.index(b'{"x":1}')
    data[at] ^= 0xFF  # the stored bytes no longer have the checksum of the directory
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "two.zip").write_bytes(data)
    damaged = {r.name: r.problem for r in bundles.read_bundles(spark, str(tmp_path / "bad")).collect()}
    assert damaged["dir/a.jsonl"] == "damaged" and damaged["ok.txt"] is None
    with pytest.raises(ValueError):
        bundles.local_path("hdfs://host/x.zip")


def test_bundles_are_split_and_rewritten_alike(spark, tmp_path):
    files = spark.range(40).select(F.expr("'b' || id % 2").alias("bundle"), F.expr("'t/' || id").alias("name"), F.expr("cast(repeat('x', cast(id as int)) as binary)").alias("content"), F.lit(None).cast("long").alias("mode"))
    for k in "12":
        assert sorted(tuple(r) for r in bundles.write_bundles(files, str(tmp_path / k)).collect()) == [("b0", 20), ("b1", 20)]
    assert (tmp_path / "1" / "b0.zip").read_bytes() == (tmp_path / "2" / "b0.zip").read_bytes()
    members = bundles.read_bundles(spark, str(tmp_path / "1"), split=200)
    assert members.rdd.getNumPartitions() > 2
    assert sorted((r.name, r.bytes, r.sha256) for r in members.collect()) == sorted((f"t/{i}", i, sha(b"x" * i)) for i in range(40))


def test_checkpoint(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), checkpoint.ROW)
    folder = str(tmp_path / "c")
    checkpoint.append_batch(rows((1, "p", "a"), (2, "p", 'b "é\n')), folder, 0)
    for _ in range(2):
        checkpoint.append_batch(rows((1, "q", None)), folder, 1)
    assert sorted(tuple(r) for r in checkpoint.read_checkpoint(spark, folder).collect()) == [(1, "q", None, 1), (2, "p", 'b "é\n', 0)]
    path = tmp_path / "c" / f"batch={2:010d}"
    path.mkdir()
    (path / "part-0.txt").write_text('{"item_id":2,"prompt_sha256":"p","response":"first"}\n{"item_id":2,"prompt_sha256":"p","response":"last"}\n{"item_id":3,"prom')
    assert {r.item_id: r.response for r in checkpoint.read_checkpoint(spark, folder).collect()} == {1: None, 2: "last"}
    assert [r.problem for r in checkpoint.scan_checkpoint(spark, folder).where("problem is not null").collect()] == ["torn"]
    (path / "part-0.txt").write_text('{"item_id":3,"prom\n{"item_id":2,"prompt_sha256":"p","response":"last"}\n')
    with pytest.raises(checks.InvariantError):
        checkpoint.read_checkpoint(spark, folder)


@pytest.mark.parametrize("width,fanout", [(4, 2), (16, 64)])
def test_digest_trees(spark, monkeypatch, width, fanout):
    monkeypatch.setattr(merkle, "WIDTH", width)
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    rows = {i: f"h{i}" for i in range(0, 300, 1) if i % 17}
    table = lambda d: spark.createDataFrame(sorted(d.items()), "input_index long, record_sha256 string")
    other = {i: h for i, h in rows.items() if i != 5} | {100: "new", 1000: "far", 17: "gap"}
    left, right = merkle.digest_tree(table(rows)), merkle.digest_tree(table(other))
    assert merkle.root(left).first().n == len(rows)
    blocks = merkle.differing_blocks(left, right)
    assert sorted(r.node for r in blocks.collect()) == sorted({i // width for i in (5, 100, 1000, 17)})
    assert sorted(tuple(r) for r in merkle.record_drift(table(rows), table(other), blocks).collect()) == [(5, "missing"), (17, "unexpected"), (100, "changed"), (1000, "unexpected")]
    assert merkle.differing_blocks(left, merkle.digest_tree(table(rows))).isEmpty()
    nothing = spark.createDataFrame([], "input_index long, record_sha256 string")
    empty = merkle.digest_tree(nothing)
    assert empty.isEmpty() and merkle.root(empty).isEmpty()
    assert merkle.record_drift(nothing, table({1: "a"}), merkle.differing_blocks(empty, merkle.digest_tree(table({1: "a"})))).collect() == [(1, "unexpected")]


def test_split_sink_keeps_the_order(spark, tmp_path):
    rows = frame(spark, [record(i, [("user", f"q{i}"), ("assistant", "a")], record_id=str(i)) for i in range(60)]).withColumn("partition", F.when(F.col("input_index") % 3 == 0, "validation").otherwise("train"))
    path = str(tmp_path / "s")
    jsonl.write_split(rows.repartition(5), path)
    want = [i for i in range(60) if i % 3]
    got = jsonl.read_split(spark, path, "train").orderBy("place").collect()
    assert [r.place for r in got] == list(range(40)) and [int(r.line.split('"record_id":"')[1].split('"')[0]) for r in got] == want
    part = jsonl.read_split(spark, path, "train", first=7, count=5).orderBy("place").collect()
    assert [r.place for r in part] == [7, 8, 9, 10, 11] and '"record_id":"11"' in part[0].line
    assert jsonl.read_split(spark, path, "other").isEmpty()


def test_places_of_rows(spark):
    df = spark.createDataFrame([(x,) for x in [5, None, 3, 3, 9, 1]], "x int")
    assert [r.x for r in work.placed(df, "at", F.col("x").asc_nulls_first()).orderBy("at").collect()] == [None, 1, 3, 3, 5, 9]
    assert work.placed(df.limit(0), "at", "x").isEmpty()


def test_records_that_share_an_index_are_refused(spark):
    rows = frame(spark, [record(1, [("user", "a"), ("assistant", "b")], record_id="1"), record(1, [("user", "c"), ("assistant", "d")], record_id="2")])
    with pytest.raises(checks.InvariantError):
        dedup.exact_duplicates(rows)


def test_work_tables_are_deleted(spark):
    table = work.written(spark.range(3), "gone")
    path = table._millrace_path
    work.discard(table, None, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_json_equality(spark):
    cases = [("1", "1e0", True), ("1.0", "1", True), ('{"a":1,"b":[1]}', '{"b": [1], "a": 1}', True), ('{"a":1,"a":2}', '{"a":2}', True), ("[1,2]", "[2,1]", False), ("{", "{", False), (None, "1", False), ('"1"', "1", False)]
    df = spark.createDataFrame(cases, "a string, b string, w boolean")
    assert all(r.g == r.w for r in df.select("w", evaluation.json_equal("a", "b").alias("g")).collect())


def test_distributions(spark):
    df = spark.createDataFrame([(i, None if i % 2 else i) for i in range(1, 101)], "a long, b long")
    got = {r.distribution: tuple(r)[1:] for r in distill.distributions(df, ["a", "b"]).collect()}
    assert got == {"a": (100, 1, 100, 50.5, 50, 90, 95, 99), "b": (50, 2, 100, 51.0, 50, 90, 96, 100)}
    assert distill.distributions(df.limit(0), ["a"]).isEmpty()


def test_equal_pairs_of_a_large_key_are_dealt_out_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PAIRS", 50)
    left = spark.range(60).selectExpr("if(id < 40, 'hot', if(id < 59, concat('k', id), null)) as k", "id as lid")
    right = spark.range(30).selectExpr("if(id < 25, 'hot', concat('k', id + 20)) as k", "id as rid")
    found = contamination.equal_pairs(left.unionAll(left), right.unionAll(right))
    assert sorted(tuple(r) for r in found.collect()) == sorted([(i, j) for i in range(40) for j in range(25)] + [(j + 20, j) for j in range(25, 30)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hot-keys" in plan and plan.count("part#") > 2


def test_overlaps_hash_only_rows_that_overlap(spark):
    """Line ends are no tokens; records are hashed after the search, not all before it."""
    texts = [("a\r\n" + WORDS, 0), ("\ufeff" + WORDS, 1), ("x " * 40, 2)]
    assert [r.n for r in spark.createDataFrame(texts, "t string, i int").select(F.size(overlap_tokens(F.col("t"))).alias("n")).collect()] == [31, 30, 40]
    rows = spark.createDataFrame([(i, [("user", "q"), ("assistant", t)]) for t, i in texts], "input_index long, messages array<struct<role: string, content: string>>")
    guard = contamination.protected_example(spark.createDataFrame([(7, WORDS)], "item_id long, text string"), "g")
    found = contamination.training_findings(with_fingerprints(rows), guard, checkers=("overlap_solution",))
    # the second is an exact match
    assert [(r.finding_type, r.score) for r in found.collect()] == [("high_solution_overlap", 1.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.index("LeftSemi") > plan.index("sha2")


def test_overlaps_within_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(contamination, "COUNTED", 1)
    rng = random.Random(9)
    common, sets = [5 << 30, 9 << 40, 11 << 44, 1 << 47], []
    for i in range(60):
        base = rng.sample(range(1 << 48), rng.randint(12, 90))
        sets.append(base + common[: i % 5])
        for _ in range(i % 3):
            kept = rng.sample(base, max(1, int(len(base) * rng.uniform(0.6, 1))))
            sets.append(kept + rng.sample(range(1 << 48), rng.choice([0, 3, 200])) + common[: rng.randint(0, 4)])
    frame_ = spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)] + [(0, sorted(set(sets[0])))], "key long, shingles array<long>")
    want = {(i, j): len(set(a) & set(b)) / min(len(set(a)), len(set(b))) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j}
    want = {k: round(v, 9) for k, v in want.items() if v >= 0.8}
    for few in (contamination.FEW_LATE, 0):
        monkeypatch.setattr(contamination, "FEW_LATE", few)
        found = contamination.overlaps_within(frame_).collect()
        assert len(found) == len(want) > 40 and {(r.lid, r.rid): round(r.raw, 9) for r in found} == want
    assert contamination.overlaps_within(frame_.limit(0)).isEmpty()


def test_texts_of_shingles_of_their_own_are_no_candidates(spark, monkeypatch):
    """Texts that share a third of their shingles need not be counted, and what finding overlaps has written and shuffled goes at once."""
    rng = random.Random(4)
    shared = rng.sample(range(1 << 48), 60)
    sets = [shared + rng.sample(range(1 << 48), 120) for _ in range(24)]
    sets.append(sets[0][:170] + rng.sample(range(1 << 48), 4))
    frame_ = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "key long, shingles array<long>")
    counts, write = {}, contamination.written

    def counted(df, name, **options):
        out = write(df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(contamination, "written", counted)
    rows = write(frame_, "some-sets")
    found = contamination.overlaps_within(rows, last=True)
    assert sorted((r.lid, r.rid, round(r.raw, 6)) for r in found.collect()) == [(0, 24, round(170 / 174, 6)), (24, 0, round(170 / 174, 6))]
    assert counts["overlap-pairs"] <= 47  # those of the two that overlap, of 300
    assert spark.conf.get(work._CLEANUP) == "false"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows._millrace_path)
    assert not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
