"""Manifests: counts, checksums and source summaries that audit a dataset without its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_list_sha256, sha256


def source_summary(records: DataFrame, retained: DataFrame) -> DataFrame:
    """Input and prepared rows of each source and revision, and whether it has one licence."""
    by = lambda df: df.groupBy(F.col("provenance.source_id").alias("source_id"), F.col("provenance.revision").alias("revision"))
    before = by(records).agg(F.count("*").alias("input"), F.count_distinct("provenance.license").alias("licenses"))
    after = by(retained).agg(F.count("*").alias("prepared"))
    out = before.join(after, ["source_id", "revision"], "left")
    return out.select("source_id", "revision", "input", F.coalesce("prepared", F.lit(0)).alias("prepared"), (F.col("licenses") == 1).alias("one_license"))


#: Hashes in a block of the ordered checksum.
BLOCK = 10_000


def _ordered(index: str, hash_: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(index, hash_))), lambda s: s[hash_])


def content_checksum(hashed: DataFrame, hash_: str = "record_sha256", index: str = "input_index") -> DataFrame:
    """One row: the digest of all hashes in order of their index, exactly as of one list of them.

    A digest of one list is one task's work by its nature: it is for a released dataset of bounded size, such as a
    frozen split; tree_checksum and block_checksums scale.
    """
    return hashed.agg(F.count("*").alias("n"), hash_list_sha256(_ordered(index, hash_)).alias("sha256"))


def block_checksums(hashed: DataFrame, hash_: str = "record_sha256", index: str = "input_index") -> DataFrame:
    """The digest of the list of hashes of each block of BLOCK indexes, in order."""
    blocks = hashed.groupBy(F.floor(F.col(index) / BLOCK).alias("block"))
    return blocks.agg(F.count("*").alias("n"), hash_list_sha256(_ordered(index, hash_)).alias("sha256"))


def tree_checksum(hashed: DataFrame, hash_: str = "record_sha256", index: str = "input_index") -> DataFrame:
    """One row: the digest of the digests of blocks of BLOCK indexes, in order; a task holds one block."""
    blocks = hashed.groupBy(F.floor(F.col(index) / BLOCK).alias("block")).agg(
        F.count("*").alias("rows"), sha256(F.array_join(_ordered(index, hash_), ",")).alias("digest")
    )
    return blocks.agg(F.sum("rows").alias("n"), sha256(F.array_join(_ordered("block", "digest"), ",")).alias("sha256"))


def manifest(counts: DataFrame, sources: DataFrame, checksum: DataFrame, contamination: str, seed: int, fraction: float) -> dict:
    """The manifest as a document, from one-row aggregates and a row for each source; stage counts must be conserved."""
    row = counts.first().asDict()
    if not row["conserved"]:
        raise ValueError(f"stage counts do not add up: {row}")
    return {
        "schema_version": 1, "counts": {k: v for k, v in row.items() if k != "conserved"}, "checksum": checksum.first().asDict(),
        "sources": [r.asDict() for r in sources.orderBy("source_id", "revision").collect()], "contamination": {"status": contamination},
        "split": {"seed": seed, "validation_fraction": fraction},
    }


def preflight_problems(document: dict, checksum: DataFrame) -> list[str]:
    """What a frozen dataset's recomputed checksum says against its manifest."""
    found = checksum.first().asDict()
    return [k for k in ("n", "sha256") if found[k] != document["checksum"].get(k)]
