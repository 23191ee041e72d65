"""Invariants as queries: rows that violate one, and an assertion that there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvariantError(ValueError):
    """An invariant of the data does not hold."""


def assert_empty(violations: DataFrame, message: str, shown: int = 3) -> None:
    """Fail if a violation query has rows; up to `shown` of them are named."""
    rows = violations.limit(shown).collect()
    if rows:
        raise InvariantError(f"{message}: {[r.asDict() for r in rows]}")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def missing_keys(wanted: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Keys of wanted that found has not."""
    return wanted.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def membership_drift(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys that are in one side only, and in which."""
    return missing_keys(left, right, *keys).withColumn("side", F.lit("missing")).unionByName(missing_keys(right, left, *keys).withColumn("side", F.lit("unexpected")))


def coverage(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Benchmarks that are registered and not loaded, or loaded and not registered."""
    return membership_drift(wanted, found, key)


def zero_filled_counts(values: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Count of each value of a fixed domain, in its order, zero counts kept."""
    known = values.sparkSession.createDataFrame(list(enumerate(domain)), f"position int, {column} string")
    counts = values.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_failing(stages: list[tuple[str, Column]]) -> Column:
    """Name of the first stage whose failure condition holds, else null."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(stages):
        out = F.when(failed, name).otherwise(out)
    return out
