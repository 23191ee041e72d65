"""Budgeted composition of a corpus from several sources.

Sources are taken in turn, the one that fills shortfalls last.  A source is read up to the row by which its
budget is met: rows beyond are neither counted nor remembered.  The number of accepted rows up to a row is a running
sum in two levels; copies are first rows of their hash within the source, and hashes that earlier sources accepted.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_fingerprints
from ..operators import filters
from ..operators.checks import first_failing
from ..work import written

STAGES = ("content", "validation", "length")


class Budget(NamedTuple):
    source_id: str
    target: int


def classify(records: DataFrame, validator: Column | None, least: int, most: int) -> DataFrame:
    """records with stage (first that refuses, or null), stage_reasons, token_count and fingerprints."""
    out = filters.filter_length(filters.filter_content(records), least, most)
    verdict = validator if validator is not None else F.struct(F.lit(True).alias("passed"), F.lit("").alias("detail"))
    out = out.withColumn("verdict", verdict)
    stage = first_failing([("content", ~F.col("accepted")), ("validation", ~F.col("verdict.passed")), ("length", F.col("length_reason").isNotNull())])
    out = out.withColumn("stage", stage)
    reasons = F.when(F.col("stage") == "content", F.col("reasons")).when(F.col("stage") == "validation", F.array(F.substring_index("verdict.detail", ";", 1)))
    return with_fingerprints(out.withColumn("stage_reasons", reasons.when(F.col("stage") == "length", F.array("length_reason")).otherwise(F.array().cast("array<string>"))))


#: Rows of input_index in a range of the running sum.
RANGE = 100_000


def _scanned(classified: DataFrame, seen: DataFrame | None, requested: int) -> DataFrame:
    """The rows that are read until `requested` are accepted; duplicates get the stage "duplicate"."""
    valid = classified.where("stage is null")
    first = valid.groupBy("record_sha256").agg(F.min("input_index").alias("_first"))
    if seen is not None:
        first = first.join(seen.select("record_sha256", F.lit(True).alias("_seen")).distinct(), "record_sha256", "left")
    else:
        first = first.withColumn("_seen", F.lit(None).cast("boolean"))
    out = classified.join(first, "record_sha256", "left")
    copy = F.col("stage").isNull() & (F.col("_seen").isNotNull() | (F.col("input_index") > F.col("_first")))
    out = out.withColumns({"stage": F.when(copy, "duplicate").otherwise(F.col("stage")), "stage_reasons": F.when(copy, F.array(F.lit("duplicate_content"))).otherwise(F.col("stage_reasons"))})
    out = out.drop("_first", "_seen").withColumns({"_ok": F.col("stage").isNull().cast("long"), "_range": F.expr(f"input_index div {RANGE}")})
    totals = out.groupBy("_range").agg(F.sum("_ok").alias("_n"))
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    before = F.coalesce(F.sum("_ok").over(Window.partitionBy("_range").orderBy("input_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # whole ranges past the cutoff go before they are ordered
    return out.join(starts.where(F.col("_start") < requested), "_range").withColumn("_before", F.col("_start") + before).where(F.col("_before") < requested).drop("_ok", "_range", "_start", "_before")


NARROW = ("input_index", "stage", "stage_reasons", "token_count", "prompt_sha256", "response_sha256", "record_sha256")


class Composition(NamedTuple):
    """scanned and accepted hold what was decided of each row (NARROW and source_order), not the records."""

    scanned: DataFrame
    accepted: DataFrame
    stats: DataFrame

    def records(self, sources: dict[str, DataFrame], budgets: list[Budget]) -> DataFrame:
        """The accepted records themselves with source_order: the one join that moves them."""
        parts = [sources[b.source_id].join(self.accepted.where(F.col("source_order") == i).select("input_index", "source_order", "record_sha256"), "input_index") for i, b in enumerate(budgets)]
        return reduce(DataFrame.unionByName, parts)


def compose(sources: dict[str, DataFrame], budgets: list[Budget], fill: str, *, validator: Column | None = None, least: int = 1, most: int = 2048) -> Composition:
    """accepted rows have source_order, that of the configuration, which is also the output's.

    A job runs for each source: how many it falls short decides what the filling one is asked for.
    """
    order = {b.source_id: i for i, b in enumerate(budgets)}
    read: dict[str, DataFrame] = {}
    short, stats, seen = 0, [], None
    for budget in sorted(budgets, key=lambda b: (b.source_id == fill, order[b.source_id])):
        requested = budget.target + (short if budget.source_id == fill else 0)
        # texts are read, checked and hashed once; what follows moves only what was decided of them
        decided = written(classify(sources[budget.source_id], validator, least, most).select(*NARROW), "classified")
        rows = written(_scanned(decided, seen, requested).withColumn("source_order", F.lit(order[budget.source_id])), "scanned")
        counts = {r["stage"]: r["n"] for r in rows.groupBy("stage").agg(F.count("*").alias("n")).collect()}
        got = counts.get(None, 0)
        short = max(0, requested - got) + (short if budget.source_id != fill else 0)
        stats.append((order[budget.source_id], budget.source_id, budget.target, requested, sum(counts.values()), *[counts.get(s, 0) for s in (*STAGES, "duplicate")], got))
        accepted = rows.where("stage is null").select("record_sha256")
        seen = accepted if seen is None else seen.unionByName(accepted)
        read[budget.source_id] = rows
    scanned = reduce(DataFrame.unionByName, read.values())
    names = "source_order int, source_id string, target long, requested long, scanned long, content_rejected long, validation_rejected long, length_rejected long, duplicate_rejected long, accepted long"
    table = scanned.sparkSession.createDataFrame(sorted(stats), names)
    return Composition(scanned, scanned.where("stage is null"), table)


def rejection_counts(composition: Composition) -> DataFrame:
    rows = composition.scanned.where("stage is not null").select("stage", F.explode("stage_reasons").alias("reason"))
    return rows.groupBy("stage", "reason").agg(F.count("*").alias("n"))
