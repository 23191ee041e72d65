import re

import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                part[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), format(fps[i], "016x"), str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", None) for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(df)
    return sorted((str(r.doc_id), format(r.fp & (2**64 - 1), "016x"), str(r.component_id)) for r in out.collect())


def test_matches_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (4, "a B"), (4, "a B"), (None, "x y z w"), (9, "word " * 70000), (None, "a b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_links_find_every_pair_of_two_bits(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for _ in range(10):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for u, v in links:
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 2
        part[root(u)] = root(v)
    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                assert root(a) == root(b)


def test_one_of_each_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", None), (2, "a b c d", "y", None), (3, "q r s", "z", None), (3, "q r s", "z", None)], SCHEMA)
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
    nameless = spark.createDataFrame([(None, "a b c d", "x", None), (None, "a b c d", "y", None), (None, "q r s", "z", None)], SCHEMA)
    assert sorted(r.text for r in simhash.one_of_each(nameless).collect()) == ["a b c d", "q r s"]


def test_components_of_long_paths_and_hubs(spark):
    from millrace.llm.common import connected_components

    path = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    out = connected_components(spark.createDataFrame(path + hub + [(5, 5)], "u long, v long"))
    got = {r.node: r.component for r in out.collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert out.groupBy("node").count().where(F.col("count") > 1).isEmpty()


def test_one_of_each_matches_brute_force_jaccard(spark):
    import random

    rng = random.Random(11)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (7, 30, 60, 100, 100, 150, 300, 500)]
    texts = [" ".join(w) for w in base]
    for words in base:
        for edits in (1, 1, 2, 3, 4, 6):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy) + rng.choice(["", " tail", " a longer tail of words"]))
    chain = [f"c{i}" for i in range(160)]
    texts += [" ".join(chain[i * 8 : i * 8 + 100]).upper() for i in range(7)] + ["", " ", "one two", "One  two"]
    shuffled = list(enumerate(texts))
    rng.shuffle(shuffled)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                part[y] = x
    want = [i for i in range(len(texts)) if root(i) == i]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in shuffled], SCHEMA)
    got = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    assert got == want and len(want) < len(texts) - 20


def test_many_near_copies_below_the_similarity_make_no_pairs(spark):
    """3,000 texts, each three words off a text that is not among them: any two share bands, none is at 4/5 with another."""
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]

    def copies(count, edits):
        out = []
        for i in range(count):
            words = list(base)
            for at in rng.sample(range(4, 96, 5), edits):  # no two of them in one shingle
                words[at] = f"x{i}y{at}"
            out.append((i, " ".join(words)))
        return out

    made = {}
    for count in (300, 3000):
        df = spark.createDataFrame(copies(count, 3), "doc_id long, text string").cache()
        sets = df.select(F.col("doc_id").alias("sid"), simhash._word_sets("text").alias("words"))
        bits = df.select(F.col("doc_id").alias("sid"), simhash._sketch("text")["bits"].alias("bits"))
        made[count] = simhash.prefix_pairs(sets.select("sid", F.size("words").alias("n"), F.col("sid").alias("part")).join(bits, "sid"), sets).count()
    assert made[3000] <= 20 * max(made[300], 150)
    assert simhash.one_of_each(df).count() == 3000
    # two words off, all are at 4/5 with the text they are copies of
    df = spark.createDataFrame([(5000, " ".join(base)), *copies(400, 2)], "doc_id long, text string")
    linked = simhash.word_duplicates(df).groupBy("part").count().collect()
    assert max(r["count"] for r in linked) == 401


def test_the_stage_gets_pairs_by_anchors_and_groups_of_near_copies_make_few_rows(spark, monkeypatch):
    """Long texts with one word changed are found by fingerprints alone; mutual near misses are not held against each other shingle by shingle."""
    import random

    rng = random.Random(7)
    words = [f"w{rng.randrange(9000)}" for _ in range(2000)]
    rows = [(i, " ".join([*words[: 100 * i], f"x{i}", *words[100 * i + 1 :]]), "x", None) for i in range(12)]
    rows += [(20 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(60)), "x", None) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = df.select("doc_id", simhash._sketch("text").alias("s")).select("doc_id", "s.*")
    assert sets.where("doc_id < 12").select("sid").distinct().count() == 12
    linked = simhash.fingerprint_pairs(sets.select("sid", "n", "fp").distinct()).collect()
    assert {s for r in linked for s in (r.u, r.v)} <= {r.sid for r in sets.where("doc_id < 12").collect()}
    # without bands all that is found comes from the anchors
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: [])
    assert linked and simhash.word_duplicates(df).where("doc_id < 12").select("part").distinct().count() < 12

    # texts of a group that differ a little more than the similarity allows: pairs of them make no rows
    base = [f"w{i}" for i in range(400)]
    near = []
    for i in range(200):
        copy = list(base)
        for at in rng.sample(range(4, 396, 5), 6):
            copy[at] = f"x{rng.randrange(4)}y{at}"
        near.append((i, " ".join(copy), "x", None))
    near = spark.createDataFrame(near, SCHEMA)
    sets = near.select(F.col("doc_id").alias("sid"), simhash._word_sets("text").alias("words"))
    bits = near.select(F.col("doc_id").alias("sid"), simhash._sketch("text")["bits"].alias("bits"))
    members = sets.select("sid", F.size("words").alias("n"), F.col("sid").alias("part")).join(bits, "sid")
    listed = {r.sid: set(r.words) for r in sets.collect()}
    true = {(a, b) for a in listed for b in listed if a < b and 5 * len(listed[a] & listed[b]) >= 4 * len(listed[a] | listed[b])}
    found = {(r.u, r.v) for r in simhash.prefix_pairs(members, sets).collect()}
    assert true <= found and len(found - true) < 200 * 199 // 20
