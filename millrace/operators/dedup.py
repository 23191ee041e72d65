"""Exact deduplication with provenance.

A row stays if it is the first of its content hash.  A repeated source identity must carry the same content,
so that the identity only annotates; identities that do not, and hash collisions, are violation queries.
First rows come from an aggregation with map-side combine and a join whose skew Spark can split, not from a window that
brings all copies of a text together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_fingerprints
from ..work import written
from .checks import assert_empty, repeated_keys

IDENTITY = ("source_id", "revision", "split", "record_id")
REASONS = ["duplicate_content", "duplicate_source_record"]


def with_identity(records: DataFrame) -> DataFrame:
    return records.select("*", *[F.col(f"provenance.{c}").alias(c) for c in IDENTITY])


HASHES = ("prompt_sha256", "response_sha256", "record_sha256")


def fingerprint_table(records: DataFrame) -> DataFrame:
    """input_index, source identity and hashes of every record: texts are read and hashed once, and stay where they are."""
    table = written(with_identity(with_fingerprints(records)).select("input_index", *IDENTITY, *HASHES), "fingerprints")
    # decisions go back to records by their index: one that two records share would multiply them
    assert_empty(repeated_keys(table, "input_index"), "records share an input_index")
    return table


def duplicate_decisions(fingerprints: DataFrame) -> DataFrame:
    """fingerprints with retained, content_duplicate_of, source_duplicate_of and reasons; no text moves.

    The back-references are the input_index of the first row of the content and of the identity.
    """
    rows = fingerprints
    first = rows.groupBy("record_sha256").agg(F.min("input_index").alias("_content"))
    named = rows.where("record_id is not null").groupBy(*IDENTITY).agg(F.min("input_index").alias("_source"))
    named = named.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY], "_source")
    same = F.col("source_id") == F.col("_source_id")
    for c in IDENTITY[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(first, "record_sha256").join(named, same, "left").drop(*[f"_{c}" for c in IDENTITY])
    before = lambda c: F.when(F.col(c) < F.col("input_index"), F.col(c))
    out = out.withColumns({"content_duplicate_of": before("_content"), "source_duplicate_of": before("_source")}).drop("_content", "_source")
    reasons = F.array_compact(F.array(F.when(F.col("content_duplicate_of").isNotNull(), REASONS[0]), F.when(F.col("source_duplicate_of").isNotNull(), REASONS[1])))
    return out.withColumns({"reasons": reasons, "retained": F.col("content_duplicate_of").isNull()})


def with_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """records with their decisions, by input_index (unique): the one place where whole records move."""
    return records.join(decisions, "input_index")


def exact_duplicates(records: DataFrame) -> DataFrame:
    """records with fingerprints, source identity and the columns of duplicate_decisions()."""
    return with_decisions(records, duplicate_decisions(fingerprint_table(records)))


def identity_conflicts(fingerprinted: DataFrame) -> DataFrame:
    """Source identities that carry more than one content."""
    groups = fingerprinted.where("record_id is not null").groupBy(*IDENTITY)
    return groups.agg(F.count_distinct("record_sha256").alias("contents")).where("contents > 1")


def hash_collisions(fingerprinted: DataFrame) -> DataFrame:
    """Record hashes under which more than one prompt and response stand."""
    return fingerprinted.groupBy("record_sha256").agg(F.count_distinct("prompt_sha256", "response_sha256").alias("contents")).where("contents > 1")
