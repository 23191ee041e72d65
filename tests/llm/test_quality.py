import numpy as np

from millrace.llm import quality
from millrace.llm.queries import queries


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40000) < 0.7
    votes = np.zeros((len(good), 5), dtype=int)
    for k, (hit, speak) in enumerate([(0.95, 0.9), (0.8, 0.8), (0.7, 1.0), (0.9, 0.5), (0.6, 0.9)]):
        right = rng.random(len(good)) < hit
        votes[:, k] = np.where(rng.random(len(good)) < speak, np.where(right == good, 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert abs(model.table[0, 1, 2] - 0.95 * 0.9) < 0.03 and abs(model.table[1, 0, 0] - 0.8 * 0.8) < 0.03
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.93


def test_patterns_count_as_rows():
    votes = np.array([[1, 1, 0], [1, 1, 0], [-1, 0, -1]])
    a = quality.fit_labels(votes, np.ones(3))
    b = quality.fit_labels(votes[[0, 2]], np.array([2.0, 1.0]))
    assert np.allclose(a.table, b.table) and np.isclose(a.prior, b.prior)


def test_query_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries()["op10_quality"](spark, sf).collect()}
    assert len(rows) == 1000
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}  # never used in fitting
    good = [rows[d].keep for d, q in labels.items() if q == 1]
    bad = [rows[d].keep for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_statistics_against_a_plain_count():
    for text in ("", "a b c", "THE the the! # é É", " \n\t", "x" * 100000 + " y"):
        words, counts, s = quality._parts(text)
        assert s.words == len(text.split()) and s.marks == text.count("#") / max(1, len(words))
        assert s.shouts == text.count("!") / max(1, len(words))
        letters = sum(c.isalpha() for c in text)
        assert abs(s.length - letters / max(1, len(words))) < 1e-12


def test_edge_rows(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, "word " * 30000), (3, "The cat sat on the mat and it was a good day for all of us.")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    out = quality.classify(df).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and quality.classify(df.limit(0)).collect() == []
    assert len({r.score for r in out if r.doc_id in (None, 1)}) == 1
    kept = quality.good_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.keep}
