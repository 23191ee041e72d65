"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    base = {rule.name: f"filter(spans, s -> s.kind = '{rule.name}')" for rule in secret_scan.BASE}
    known = ", ".join(f"'{name}'" for name in base)
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.begin, ':', s.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size({spans}) as bigint)").alias(f"n_{name}") for name, spans in base.items()],
        F.sha2(F.expr(joined.format(f"filter(spans, s -> s.kind in ({known}))")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tkey")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS r(i)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM p JOIN n USING (item_id) WHERE n_shared >= ceil(round(n_item * 0.8, 6))
"""


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_score

    return lm_score.score(read_table(spark, sf_dir, "documents"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mpeg_audio

    read = mpeg_audio.probe(mpeg_audio.store_texts(read_table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.shuffle_to_shards(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(read_table(spark, sf_dir, "documents")).drop("tkey")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.long_form(*whitening.whiten(read_table(spark, sf_dir, "embeddings")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.encode(read_table(spark, sf_dir, "documents"), digests=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.trie_nodes(read_table(spark, sf_dir, "conversations"))


#: Every prefix as a list of turns; crc32 by its bits.
OP13_SQL = """
WITH o AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce("text", '')) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY i) AS ts FROM o GROUP BY c),
crc AS (SELECT c, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, k::INTEGER, 1))::BIGINT)),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h FROM own),
built AS (SELECT x.c, list_concat(coalesce(b.ts[1:x.h], []), x.ts[x.h + 1:]) AS ts FROM crc x LEFT JOIN own b ON b.c = x.c - x.c % 100),
pre AS (SELECT c, d, len(ts) = d AS stops, ts[1:d] AS p FROM built, unnest(range(0, len(ts) + 1)) AS r(d)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (stops), '') AS ends FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY p[1:d - 1]),
own_sums AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.p[d].t) ELSE 0 END AS saving FROM nodes n LEFT JOIN kids k ON k.p = n.p),
below AS (SELECT p[1:a] AS p, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM own_sums, unnest(range(0, d + 1)) AS r(a) GROUP BY p[1:a])
SELECT s.conv_id, s.d AS depth, up.conv_id AS parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved_tokens, sha256(s.ends) AS ends_sha256
FROM own_sums s JOIN below b ON b.p = s.p LEFT JOIN nodes up ON s.d > 0 AND up.p = s.p[1:s.d - 1]
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_decontamination, op3_substrings, op4_pitman_yor, op5_mpeg_audio, op6_sharding, op7_toxicity, op8_simhash, op9_packing, op10_quality, op11_whitening, op12_sentencepiece, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op13_prefix_trie": OP13_SQL}
