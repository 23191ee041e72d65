import hashlib
import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import prefix_trie
from millrace.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])  # the remainder as SQL has it
    return out


def brute(conversations):
    members, ends = defaultdict(set), defaultdict(list)
    for c, ts in conversations.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].add(c)
        ends[ts].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def nodes(df):
    return sorted(tuple(r) for r in prefix_trie.trie_nodes(df).collect())


def test_query_against_brute_force_and_sql(spark):
    got = sorted(tuple(r) for r in queries()["op13_prefix_trie"](spark, SF).collect())
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got == brute(rebuilt([tuple(r) for r in table]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{Path(SF) / 'conversations.parquet'}'")
    out = queries()["op13_prefix_trie"](spark, SF)
    rel = con.sql(oracle_sql()["op13_prefix_trie"])
    order = [rel.columns.index(c) for c in out.columns]
    assert sorted(tuple(r[i] for i in order) for r in rel.fetchall()) == got


@pytest.mark.parametrize("seed,few", [(1, 250_000), (2, 0)])
def test_branching_conversations(spark, monkeypatch, seed, few):
    """Few different turns, so that conversations share prefixes, part within edges, end on one another's path and repeat."""
    monkeypatch.setattr(prefix_trie, "FEW", few)
    rng = random.Random(seed)
    rows = []
    for c in [*range(260), 1003, -7, 10**12]:
        stem = [rng.choice("ab") * 3 for _ in range(rng.choice([0, 1, 1, 2, 5]))] + ["s"] * rng.choice([0, 0, 20, 37])
        for t, text in enumerate((stem + [rng.choice("abc") for _ in range(rng.randint(0, 9))]) or ["x"]):
            rows.append((c, t, rng.choice(["user"] * 9 + ["bot"]), text))
    rng.shuffle(rows)
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rebuilt(rows))


def test_edge_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, 0, "user", "é"), (100, 3, "user", "long" * 50_000), (5, 0, "user", "x"), (101, 0, "", ""), (7, 0, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"p": F.lit("clash"), "d": F.lit(1), "len": F.lit(2)})
    assert nodes(df) == brute(rebuilt(rows))
    assert nodes(df.limit(0)) == []
    for c in range(30):  # some are turnless: the root alone
        if not rebuilt([(c, 0, "user", "a")])[c]:
            assert nodes(spark.createDataFrame([(c, 0, "user", "a")], SCHEMA)) == brute({c: ()})
            break


def test_fat_binary_search_asks_few_handles(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "lo int, hi int").selectExpr("lo", "hi", f"{prefix_trie.fattest('lo', 'hi')} as f").collect()
    for r in got:
        assert r.f == max(range(r.lo + 1, r.hi + 1), key=lambda x: x & -x)


def test_nodes_are_compacted_and_located(spark):
    """Edges join at their ends, each is found by its handle, and a conversation finds its exit node and what it shares."""
    texts = {1: "aaaaaaaa", 2: "aaaabbbb", 3: "aaaabbcc", 4: "dd"}
    rows = [(c, i, "u", t) for c, s in texts.items() for i, t in enumerate(s)]
    paths = prefix_trie.prefixes(prefix_trie.turn_hashes(spark.createDataFrame([*rows, *[(9, i, "u", t) for i, t in enumerate("aaaabbcx")], (8, 0, "u", "z")], SCHEMA)))
    trie = prefix_trie.ZFastTrie(paths.select("conv_id", "p"))
    trie.insert(paths.where("conv_id in (1, 4)").select("conv_id", "len", "p"))
    assert sorted((r.pd, r.e) for r in trie.nodes.collect()) == [(0, 2), (0, 8)]
    trie.insert(paths.where("conv_id in (2, 3)").select("conv_id", "len", "p"))
    assert sorted((r.pd, r.e) for r in trie.nodes.collect()) == [(0, 2), (0, 4), (4, 6), (4, 8), (6, 8), (6, 8)]
    found = {r.conv_id: (r.x, r.epd, r.ee) for r in trie.locate(paths.where("conv_id in (1, 8, 9)").select("conv_id", "len", "p")).collect()}
    assert found == {1: (8, None, None), 8: (0, None, None), 9: (7, 6, 8)}
