import random
import re

import duckdb

from millrace.llm import decontam
from millrace.llm.queries import oracle_sql, queries


def brute(docs, items):
    def shingles(text, k):
        w = re.findall(r"\w+", (text or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = []
    for i, t in set(items):
        k = min(5, len(re.findall(r"\w+", (t or "").lower())))
        q = shingles(t, k) if k else set()
        for d, x in set(docs):
            n = len(q & shingles(x, k)) if q else 0
            if q and n >= 0.8 * len(q) - 1e-9:
                out.append((d, i, n, len(q)))
    return sorted(out, key=str)


def run(spark, docs, items):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_item int")
    it = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contained_items(df, it).collect()
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in out), key=str)


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duckdb.sql(oracle_sql()["op2_decontamination"]).fetchall()
    got = queries()["op2_decontamination"](spark, sf).select("doc_id", "item_id", "n_shared", "n_item", "containment").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5


def test_threshold_edges_and_odd_rows(spark, monkeypatch):
    words = [f"w{i}" for i in range(24)]  # 20 shingles
    item = " ".join(words)
    docs = [(1, "junk " + item.upper().replace(" ", ", ") + " more"), (2, " ".join(words[:20])), (3, " ".join(words[:19])), (None, None), (5, ""), (6, "filler " * 30000 + item), (6, item), (6, item), (None, item), (8, "the cat"), (9, "a b")]
    items = [(10, item), (10, item), (11, "The cat"), (12, None), (13, ""), (None, "a b"), (14, " ".join(words[3:12]))]
    want = brute(docs, items)
    assert (2, 10, 16, 20) in want and not any(r[:2] == (3, 10) for r in want)
    assert run(spark, docs, items) == want
    monkeypatch.setattr(decontam, "BLOCK", 10)
    assert run(spark, docs, items) == want
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_scattered_shingles_are_found(spark):
    words = [f"w{i}" for i in range(60)]
    parts = " ".join(w if i % 30 else f"x {w}" for i, w in enumerate(words))
    assert run(spark, [(1, parts)], [(1, " ".join(words))]) == brute([(1, parts)], [(1, " ".join(words))]) != []


def test_without_benchmark(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "k"), (2, "q", "k"), (None, None, None)], "doc_id long, text string, item_id string")
    out = decontam.without_benchmark(df, spark.createDataFrame([(1, "b c d e f")], "item_id long, text string"))
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["2", "None"]


def test_the_search_finds_and_the_result_depends_on_it(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(r[0], r[1]) for r in brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])}
    found = {(r.doc_id, r.item_id) for r in decontam.candidates(docs, items).collect()}
    assert len(found & want) >= 0.9 * len(want) > 5
    # documents that share a shingle with an item are many more than the candidates
    of = lambda t: decontam.shingles_of(decontam.words_of(t or ""), 5)
    theirs = {r.item_id: of(r.text) for r in items.collect()}
    touched = {(r.doc_id, i) for r in docs.collect() for i, q in theirs.items() if q & of(r.text)}
    assert found <= touched
    of_rows = decontam.Block.of
    monkeypatch.setattr(decontam.Block, "of", classmethod(lambda cls, rows: of_rows(rows)._replace(lookup={})))
    assert decontam.contained_items(docs, items).count() == 0


def test_recall_at_the_threshold_before_verification():
    rng = random.Random(3)
    for n in (5, 20, 40, 300, 3000):
        missed = 0
        for k in range(200):
            words = [f"w{k}x{i}" for i in range(n + 4)]
            all_ = sorted(decontam.shingles_of(words, 5))
            block = decontam.Block.of([{"n_item": len(all_), "all": all_, "sketch": decontam.sketch_of(all_)}])
            have = set(rng.sample(all_, -(-4 * n // 5)))
            hit = any(set(band) <= have for band in decontam.sketch_of(all_))
            assert block.search(words) == [0]
            missed += not hit
        assert missed <= 1


def test_an_item_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 7)
    words = [f"w{i}" for i in range(60)]
    docs = [(1, "x " + " ".join(words) + " y"), (2, " ".join(words[:50])), (3, " ".join(words[:40]))]
    items = [(1, " ".join(words)), (2, " ".join(words[:9]))]
    assert run(spark, docs, items) == brute(docs, items) != []
    assert all(len(r.all) <= 7 for r in decontam.sketches(spark.createDataFrame(items, "item_id long, text string")).collect())
