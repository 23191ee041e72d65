"""Joins with declared membership, and set checks between datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import assert_empty, membership_drift, repeated_keys


def exact_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join of sides that must have the same keys, each once; anything else is an error."""
    for side, name in ((left, "left"), (right, "right")):
        assert_empty(repeated_keys(side, *keys), f"the {name} side repeats keys")
    assert_empty(membership_drift(left, right, *keys), "the sides have different keys")
    return left.join(right, list(keys))


def subset_join(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """Inner join where all keys of part must be in whole."""
    assert_empty(part.join(whole, list(keys), "left_anti").select(*keys), "keys that the whole has not")
    return part.join(whole, list(keys))


def partition_violations(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that are in no part, in several, or in a part and not in the whole; one pass over all of them."""
    marked = whole.select(F.col(key), F.lit("").alias("part"))
    for name, part in parts.items():
        marked = marked.unionAll(part.select(F.col(key), F.lit(name).alias("part")))
    held = marked.groupBy(key).agg(F.count_if(F.col("part") == "").alias("inside"), F.count_distinct(F.when(F.col("part") != "", F.col("part"))).alias("parts"))
    problem = F.when(F.col("inside") == 0, "not_in_whole").when(F.col("parts") == 0, "in_no_part").when(F.col("parts") > 1, "in_several_parts")
    return held.select(key, problem.alias("problem")).where("problem is not null")


def guarded_sources(selectors: DataFrame, registry: DataFrame) -> DataFrame:
    """Training selectors (dataset_id, selector) that the registry of protected benchmarks lists."""
    return selectors.join(registry.select("dataset_id").distinct(), "dataset_id", "left_semi")
