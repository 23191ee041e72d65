import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from millrace.llm import lm_score as lm


def brute(docs):
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"]

    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs}
    c = Counter(w for d, t in docs if not held[d] for w in tokens(t))
    N, V = sum(c.values()), len(c)
    return {(d, t): (held[d], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), N, sum(math.log10((c[w] + 1) / (N + V + 1)) for w in tokens(t))) for d, t in docs}


def check(spark, docs, monkeypatch, at_hand):
    monkeypatch.setattr(lm, "AT_HAND", at_hand)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, word int")
    rows = lm.score(df).collect()
    want = sorted((str(d), *brute(docs)[d, t]) for d, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
    return rows


def test_documents(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = check(spark, docs, monkeypatch, 50)
    again = lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert np.allclose(sorted(r.score for r in rows), sorted(r.score for r in again))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in rows)


def test_edge_rows(spark, monkeypatch):
    check(spark, [(None, None), (None, "a"), (1, ""), (5, "A b"), (5, "A b"), (5, "c"), (8, "word " * 40000), (9, "é " + "x" * 3000)], monkeypatch, 2)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_probabilities_sum_to_one(spark):
    words = Counter({b"ab": 5, b"b": 3, b"abc": 1, b"": 4, b"ca": 2})
    df = spark.createDataFrame([(bytearray(w), float(n)) for w, n in words.items()], "word binary, t double")
    spelling = lm.fit_spelling(df)
    spelling.log10([b"x"])
    table = 10.0 ** spelling.table.astype(float).reshape(65536, 256)
    assert np.allclose(table[[0x2020, 0x2061, 0x6162, 0x0000]].sum(axis=1), 1, atol=1e-5)
    model = lm.WordModel(15, 5, 0.4, 7.0, spelling)
    c = np.array(list(words.values()), float)
    t = np.array([2, 1, 1, 2, 1.0])
    p = 10 ** model.log10(list(words), c, t)
    unknown = model.backoff * (1 - (10 ** spelling.log10(list(words))).sum())
    assert math.isclose(p.sum() + unknown, 1, rel_tol=1e-5)


def test_contexts_sum_to_one_and_share_parents(spark):
    texts = ["a b a b a c", "a b d", "a b a b", None, "", "x" * 5000]
    train = spark.createDataFrame([(t or "",) for t in texts], "text string")
    _, words = lm.fit(train)
    model = lm.fit_contexts(train, words)
    table = 10.0 ** model.logs.astype(float).reshape(-1, lm.DISHES + 1)
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
    a, b, d = (model.ranked.index(w) for w in (b"a", b"b", b"d"))
    # b follows a, and a follows b; what has never followed a comes from a's ending, and that from the root
    assert table[a, b] > 0.4 > table[b, b] and table[b, a] > 0.3 > table[a, a]
    ratio = table[a] / table[lm.CONTEXTS + lm.ending(b"a")]
    assert math.isclose(ratio[lm.DISHES], ratio[d], rel_tol=1e-3) and ratio[b] > ratio[d]


def test_pair_counts(spark):
    texts = ["a b a", "", "b  b\tc"]
    ranked = [b"", b"a", b"b"]
    rows = list(lm._count_pairs(ranked)(iter([pd.DataFrame({"text": texts})])))[0]
    want = Counter()
    for t in texts:
        words = [b"", *t.encode().split(), b""]
        for x, y in zip(words, words[1:]):
            context = ranked.index(x) if x in ranked else lm.CONTEXTS + lm.ending(x)
            want[context * (lm.DISHES + 1) + (ranked.index(y) if y in ranked else lm.DISHES)] += 1
    assert dict(zip(rows["code"].tolist(), rows["n"].tolist())) == want
    assert len(lm.pairs_of([b""], {})) == 0


def test_blocks_seat_like_one(monkeypatch):
    monkeypatch.setattr(lm, "_CHUNK", 100)
    n, where = np.full(1000, 4.0), np.arange(1000) // 300
    parts = lm.gibbs_in_blocks(n, np.full(1000, 0.1), where, 0.5, np.random.default_rng(1))
    whole = lm.gibbs(n, np.full(1000, 0.1), where, 0.5, np.random.default_rng(2))
    assert abs(parts.mean.mean() - whole.mean.mean()) < 0.1
    assert len(lm.gibbs_in_blocks(np.zeros(0), np.zeros(0), np.zeros(0, int), 0.5, np.random.default_rng(0)).tables) == 0


def test_spelling_codes():
    codes, lengths = lm.spell([b"ab", b"", b"c"])
    assert [bytes([c >> 16, c >> 8 & 255, c & 255]) for c in codes] == [b"  a", b" ab", b"ab ", b"   ", b"  c", b" c "]
    assert lengths.tolist() == [3, 1, 2]


def test_gibbs_follows_the_restaurant():
    """The mean number of tables of one dish against its exact law, over all seatings of five customers."""
    a, d, n = 0.8, 0.3, 5
    law = {(1,): 1.0}
    for _ in range(n - 1):
        after = Counter()
        for sizes, p in law.items():
            room = (lm.STRENGTH + d * len(sizes)) * a
            for i, s in enumerate(sizes):
                after[tuple(sorted(sizes[:i] + (s + 1,) + sizes[i + 1 :]))] += p * (s - d)
            after[tuple(sorted((*sizes, 1)))] += p * room
        law = after
    want = sum(len(s) * p for s, p in law.items()) / sum(law.values())
    dishes = 4000
    got = lm.gibbs(np.full(dishes, n), np.full(dishes, a), np.arange(dishes), d, np.random.default_rng(0))
    assert abs(got.mean.mean() - want) < 0.05


def exact_mean(c, b, d, others, most):
    """Mean tables of a dish of c customers, by the recursion of the ways to seat them and the restaurant's law."""
    ways = np.full(most + 2, -np.inf)
    ways[1] = 0.0
    t = np.arange(most + 2)
    for n in range(1, c):
        stay = np.where(n > d * t, np.log(np.maximum(n - d * t, 1e-300)), -np.inf) + ways
        ways = np.logaddexp(stay, np.concatenate([[-np.inf], ways[:-1]]))
    t = t[1 : min(c, most) + 1]
    law = ways[t] + t * math.log(d * b) + np.array([math.lgamma(lm.STRENGTH / d + others + x) for x in t])
    law = np.exp(law - law.max())
    return (law * t).sum() / law.sum()


def test_default_settings_follow_the_exact_law_at_all_sizes():
    for d, b, others in ((0.7, 0.5, 0.0), (0.7, 0.01, 0.0), (0.3, 0.2, 0.0), (0.9, 0.3, 0.0), (0.7, 0.1, 1000.0), (0.6, 0.3, 5000.0)):
        for c in (2, 5, 20, 100, 1000):
            n = 3000 if others < 2000 else 200
            got = lm.gibbs(np.full(n, float(c)), np.full(n, b), np.arange(n), d, np.random.default_rng(1), np.full(n, others)).mean.mean()
            want = exact_mean(c, b, d, others, 1000)
            assert abs(got / want - 1) < 0.05, (d, b, others, c, got, want)
    # the state goes on: a sweep from a seating stays at the law
    n = 3000
    one = lm.gibbs(np.full(n, 300.0), np.full(n, 0.5), np.arange(n), 0.7, np.random.default_rng(2))
    two = lm.gibbs(np.full(n, 300.0), np.full(n, 0.5), np.arange(n), 0.7, np.random.default_rng(3), tables=one.tables)
    assert abs(two.mean.mean() / exact_mean(300, 0.5, 0.7, 0.0, 300) - 1) < 0.05


def test_scores_do_not_depend_on_partitions(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = ({(r.doc_id, r.n_tokens): (r.score, r.spelled_score) for r in lm.score(df.repartition(k)).collect()} for k in (1, 9))
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k], rtol=1e-9) for k in one)


def test_keys_and_streams():
    texts = [b"a bc\t a", b"", "é\n".encode()]
    words = lm.stream_of(texts)
    flat = [b"", b"a", b"bc", b"a", b"", b"", "é".encode(), b""]
    assert words.key.tolist() == lm.keys_of(flat).tolist() and len(set(words.key.tolist())) == 4
    assert words.end.tolist() == [w == b"" for w in flat]
    assert [lm._endings()[c] for c in words.last] == [lm.ending(w) for w in flat]
    assert sum(len(p) for _, p in lm.pieces_of([b"x" * (lm._PIECE - 1)] * 5)) == 5


def test_counts_by_streams_are_those_of_pairs():
    texts = ["a b a", "", "b  b\tc dd", "A é c"]
    ranked = [b"", b"a", b"b"]
    keys = np.append(lm.keys_of(ranked), np.uint64(2**64 - 1))
    order = np.argsort(keys)
    batch = pd.DataFrame({"text": texts})
    old, new = (list(f(iter([batch])))[0] for f in (lm._count_pairs(ranked), lm._count_codes(keys[order], np.append([0, 1, 2], lm.DISHES)[order])))
    size = (lm.CONTEXTS + lm.ENDINGS) * (lm.DISHES + 1)
    pairs = new[new["code"] < size]
    assert pairs["code"].tolist() == old["code"].tolist() and pairs["n"].tolist() == old["n"].tolist()
    # c after b, é after a: rare words after frequent ones
    want = Counter(size + ranked.index(u) * lm.CLASSES + int(lm.class_of(lm.keys_of([w]))[0]) for u, w in ((b"b", b"c"), (b"a", "é".encode())))
    assert dict(new[new["code"] >= size].itertuples(index=False, name=None)) == want


def test_restaurants_of_pairs_sum_to_one():
    rng = np.random.default_rng(0)
    words, groups = 50, 7
    p = rng.dirichlet(np.ones(words))
    seen = [(g, w) for g in range(groups) for w in rng.choice(words, 300 if g else 0, p=p)]
    asked = [(g, w) for g in range(groups) for w in range(words)]
    group, word = np.array(seen + asked).T
    train = np.arange(len(group)) < len(seen)
    logs = lm.seat_pairs(group, word, np.log10(p[word]), train, np.random.default_rng(1))
    found = (10 ** logs[len(seen) :]).reshape(groups, words)
    assert np.allclose(found.sum(axis=1), 1)
    # a group without customers leaves the base as it is
    assert np.allclose(found[0], p)


def test_pairs_of_rare_words_have_restaurants(spark, monkeypatch):
    """Beyond all dishes and contexts, a pair seen often is likelier than one of the same words never seen."""
    rng = np.random.default_rng(3)
    some = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    # 12,000 words more frequent than x, y, v and w, which are beyond the dishes
    common = [f"c{i}" for i in range(12_000)]
    texts = {i: " ".join(rng.permutation(common)[:3_000]) for i in some}
    for i in some[:6]:
        texts[i] += " xx yy c1 vv ww"
    texts |= {out[0]: "xx yy", out[1]: "xx ww", out[2]: "vv ww", out[3]: "vv yy", out[4]: "xx zz"}
    docs = list(texts.items())
    monkeypatch.setattr(lm, "AT_HAND", 100)
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (d, _), want in brute(docs).items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and math.isclose(r.base_score, want[4], rel_tol=1e-9)
    assert rows[out[0]].score > rows[out[1]].score + 1 and rows[out[2]].score > rows[out[3]].score + 1
    assert rows[out[4]].n_known == 2 and rows[out[4]].spelled_score < rows[out[4]].score
    assert all(math.isfinite(r.score) for r in rows.values())


def test_gathered_columns(spark):
    df = spark.createDataFrame([(bytearray(b"b"), 1, 0.5), (bytearray(b""), 2, 0.25), (bytearray(b"a"), 3, 1.0)], "word binary, c long, lp double").repartition(2)
    key, c, lp = lm.gathered(df, word="u8", c="f8", lp="f8")
    keys = lm.keys_of([b"b", b"", b"a"]).tolist()
    assert sorted(zip(key.tolist(), c.tolist(), lp.tolist(), strict=True)) == sorted(zip(keys, [1.0, 2.0, 3.0], [0.5, 0.25, 1.0], strict=True))
    assert [len(x) for x in lm.gathered(df.where("c > 9"), word="u8", lp="f8")] == [0, 0]


def test_words_at_hand_are_no_rows_on_the_driver(spark):
    """Whole rows of 60,000 words are over 20 MB of objects; their keys and numbers are 1.4 MB."""
    n = 60_000
    words = spark.range(n, numPartitions=4).selectExpr("cast(concat('word', id) as binary) as word", f"{n} - id as c", "-5.0D as lp", "1e-9D as spelled")
    ranked = [b"word%d" % i for i in range(100)]
    contexts = lm.ContextModel(ranked, np.zeros(1, np.float32), -0.1, np.zeros((lm.CONTEXTS, lm.CLASSES)))
    model = lm.WordModel(n * (n + 1) // 2, n, 0.5, float(n), None)
    tracemalloc.start()
    hand = lm._at_hand(model, contexts, words, -6.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    at, dish = hand.find(lm.keys_of([*ranked, b"word100", b"word59999", b"none"]))
    assert dish.tolist() == [*range(100), lm.DISHES, lm.DISHES, lm.DISHES] and at[-1] == -1 and (at[:-1] >= 0).all()
    assert np.allclose(hand.counted[at[[0, 100, 101]]], np.log10([n + 1, n - 99, 2]))


def test_jobs_do_not_grow_with_shuffle_partitions(spark):
    train = spark.createDataFrame([("a b a c",), ("b c d",)], "text string")
    _, words = lm.fit(train)
    context, jobs = spark.sparkContext, []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        for partitions in (10, 40):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            context.setJobGroup(f"contexts-{partitions}", "")
            lm.fit_contexts(train, words)
            jobs.append(len(context.statusTracker().getJobIdsForGroup(f"contexts-{partitions}")))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < jobs[0] == jobs[1]


def test_few_words_are_spelled_without_the_table(spark):
    words = [b"ab", b"b", b"abc", b"", b"ca"]
    spelling = lm.fit_spelling(spark.createDataFrame([(bytearray(w), 2.0) for w in words], "word binary, t double"))
    stream = lm.stream_of([b"ab unseen \xc3\xa9", b"ca b"])
    which = np.flatnonzero(~stream.end)
    found = stream.spelled(spelling, which)
    assert spelling.table is None
    assert np.allclose(found, spelling.log10([b"ab", b"unseen", b"\xc3\xa9", b"ca", b"b"]), rtol=1e-6)
    none = lm.Spelling(np.zeros(0, np.int32), np.zeros(0), np.ones(65536), np.full((256, 256), 1 / 256))
    assert np.allclose(none.log10_of_few([b"ab", b""]), none.log10([b"ab", b""]))
