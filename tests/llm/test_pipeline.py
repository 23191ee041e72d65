import re

import corpus_pipeline
from millrace.llm import decontam, packing, quality, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # 1. the scorer fitted to the whole table, applied one text at a time
    _, scorer = quality.fit(docs)
    kept = {}
    for d, t in texts.items():
        _, counts, s = quality._parts(t)
        if scorer.score(*quality.features(t, counts, s)) >= quality.THRESHOLD:
            kept[d] = t
    assert 0 < len(kept) < len(texts)
    # 2. the Jaccard similarity of all pairs by five-word shingles, the smallest id of each group
    def words5(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {d: words5(t) for d, t in kept.items()}
    part = {d: d for d in kept}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    for a in kept:
        for b in kept:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    kept = {d: t for d, t in kept.items() if root(d) == d}
    # 3. shared five-word shingles
    runs = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    items = [runs(b) for b in benchmark]
    kept = {d: t for d, t in kept.items() if not any(len(q & runs(t)) >= decontam.THRESHOLD * len(q) for q in items)}
    # 4. and 5.
    rules = [(r, re.compile(r.pattern)) for r in secret_scan.RULES]
    for d, t in kept.items():
        for _, a, b in reversed(secret_scan.spans_of(t, rules)):
            t = t[:a] + "[SECRET]" + t[b:]
        kept[d] = t
    encoder = packing.Encoder()
    want = sorted((d, len(encoder.encode(t)) // 4 + 1) for d, t in kept.items())

    lengths: dict[int, int] = {}
    sequences: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert sorted(lengths.items()) == want
    assert max(sequences.values()) <= 2048


def test_stages_keep_the_columns_and_take_odd_tables(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "The cat sat on the mat and it was a good day for all of us.", "en", "s", 59), (2, "The cat sat on the mat and it was a good day for all of us.", "en", "s", 59)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, shape)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), shape)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert bool(out) == bool(table)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "secrets", "pack"] and corpus_pipeline.ORACLE_SQL is None
