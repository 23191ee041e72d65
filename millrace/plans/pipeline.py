"""The dataset pipeline: normalise, filter, validate, length, dedup, contamination, split, counts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import contamination, dedup, filters, split


class Stages(NamedTuple):
    """Every stage's rows.  Only the fingerprints have been written, and the count that the split asks for run."""

    #: all records with accepted and length_reason, before any is dropped
    marked: DataFrame
    filtered: DataFrame
    validated: DataFrame
    measured: DataFrame
    #: narrow: no messages
    decisions: DataFrame
    deduplicated: DataFrame
    retained: DataFrame
    findings: DataFrame | None
    split: DataFrame | None


def prepare(
    records: DataFrame,
    *,
    least: int = 1,
    most: int = 2048,
    validators: dict[str, filters.Validator] | None = None,
    protected: DataFrame | None = None,
    fraction: float | None = 0.05,
    seed: int = 1729,
    count: Callable[[Column], Column] = filters.word_token_count,
) -> Stages:
    """Validators annotate here and never drop; contamination only reports, after dedup and before the split."""
    filtered = filters.filter_content(records)
    validated = filters.with_validation(filtered.where("accepted"), validators or {})
    measured = filters.filter_length(validated, least, most, count)
    fitting = measured.where("length_reason is null").drop("reasons")
    decisions = dedup.duplicate_decisions(dedup.fingerprint_table(fitting))
    deduplicated = dedup.with_decisions(fitting, decisions)
    retained = deduplicated.where("retained")
    findings = None if protected is None else contamination.training_findings(retained, protected)
    parts = None if fraction is None else split.leakage_safe_split(retained, fraction=fraction, seed=seed)
    return Stages(filters.filter_length(filtered, least, most, count), filtered, validated, measured, decisions, deduplicated, retained, findings, parts)


def stage_counts(stages: Stages) -> DataFrame:
    """One row: rows in, refused by each stage, and left; `conserved` if they add up.

    Refusals are counted in one pass over the records, duplicates over the written fingerprints.
    """
    refused = F.col("accepted") & F.col("length_reason").isNotNull()
    a = stages.marked.agg(F.count("*").alias("input"), F.count_if(~F.col("accepted")).alias("content_rejected"), F.count_if(refused).alias("length_rejected"))
    c = stages.decisions.agg(F.count_if(~F.col("retained")).alias("duplicates"), F.count_if("retained").alias("retained"))
    one = a.join(F.broadcast(c))
    return one.withColumn("conserved", F.col("input") == F.col("content_rejected") + F.col("length_rejected") + F.col("duplicates") + F.col("retained"))
