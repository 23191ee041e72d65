import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.queries import queries


def test_query_places_every_document(spark):
    sf = "/root/testdata/sf0.001"
    out = queries()["op6_sharding"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d.doc_id, len(d.text.encode()) + 16, zlib.crc32(d.text.encode())) for d in docs)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, 2), (3, "é", 3)], "doc_id long, text string, shard int")
    out = sharding.shuffle_to_shards(df, 2).collect()
    assert sorted(r["size"] for r in out) == [16, 16, 18] and Counter(r["shard"] for r in out).most_common(1)[0][1] == 2
    assert sharding.shuffle_to_shards(df.limit(0), 2).collect() == []
    assert len(sharding.shuffle_to_shards(df, 40).collect()) == 3


def test_matrix_sums(spark):
    counts = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(23)], "block int, n long")
    got = {r.block: r.caps for r in sharding.communication_matrix(counts, 7).collect()}
    total = sum((i * 7919) % 1000 for i in range(23))
    assert all(sum(got[i]) == (i * 7919) % 1000 for i in range(23))
    assert [sum(c[s] for c in got.values()) for s in range(7)] == [total // 7 + (s < total % 7) for s in range(7)]


@pytest.mark.parametrize("N,K,n", [(50, 20, 10), (9, 8, 5), (400, 3, 399)])
def test_draws_follow_the_hypergeometric_law(spark, N, K, n):
    trials = 20000
    df = spark.range(trials).withColumn("u", (F.col("id") + 0.5) / trials)
    got = Counter(r.x for r in df.select(F.expr(sharding._draw(f"{N}L", f"{K}L", f"{n}L", "u")).alias("x")).collect())
    for x in range(max(0, n - (N - K)), min(n, K) + 1):
        p = math.comb(K, x) * math.comb(N - K, n - x) / math.comb(N, n)
        assert abs(got[x] / trials - p) < 2e-4
    assert sum(got.values()) == trials
