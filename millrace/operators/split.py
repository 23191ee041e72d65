"""Splits: leakage-safe by prompt groups, by hash, and by stratum."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..work import written

#: Ranges of the ordering hash by which running sums are cut: its first two digits.
RANGES = 256


def validation_target(total: int, fraction: float) -> int:
    """Half-even rounding, at least one row on either side."""
    return max(1, min(total - 1, round(total * fraction)))


def ordering_hash(seed: int, prompt: Column) -> Column:
    return sha256(F.concat(F.lit(f"{seed}"), F.lit("\0"), prompt))


def running_total(df: DataFrame, order: Column, value: Column, name: str) -> DataFrame:
    """df with the running sum of value along a hex hash `order`, in two levels: ranges of the hash, then within them.

    A window over all rows would be one task; the ranges are as many tasks, and their totals are RANGES rows.
    """
    out = df.withColumns({"_order": order, "_value": value}).withColumn("_range", F.conv(F.substring("_order", 1, 2), 16, 10).cast("int"))
    totals = out.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = out.withColumn("_sum", F.sum("_value").over(within)).join(F.broadcast(starts), "_range")
    return summed.withColumn(name, (F.col("_start") + F.col("_sum")).cast("long")).drop("_order", "_value", "_range", "_sum", "_start")


def prompt_groups(fingerprinted: DataFrame) -> DataFrame:
    return fingerprinted.groupBy("prompt_sha256").agg(F.count("*").alias("size"))


def leakage_safe_split(retained: DataFrame, *, fraction: float, seed: int, order: str = "native") -> DataFrame:
    """retained rows (with prompt_sha256) with partition train or validation; rows of one prompt stay together.

    Groups are put in a seeded order, and the validation set is the prefix of them whose number of rows is closest to
    the target, under it on a tie.  order: "native" sorts by a salted hash; "compat" shuffles the sorted prompts with
    Python's generator, on the driver, for splits that must equal ones made so.
    """
    groups = written(prompt_groups(retained), "prompt-groups")  # a hash and a count each; read three times
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    target = validation_target(total, fraction)
    if order == "compat":
        prompts = [r[0] for r in groups.select("prompt_sha256").orderBy("prompt_sha256").collect()]
        random.Random(seed).shuffle(prompts)
        ranks = retained.sparkSession.createDataFrame([(p, f"{i:064x}") for i, p in enumerate(prompts)], "prompt_sha256 string, at string")
        groups = groups.join(ranks, "prompt_sha256")
        window = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = groups.withColumn("cumulative", F.sum("size").over(window))
    else:
        summed = running_total(groups, ordering_hash(seed, F.col("prompt_sha256")), F.col("size"), "cumulative")
    # the last group never goes to validation
    key = F.struct(F.abs(F.col("cumulative") - target).alias("a"), (F.col("cumulative") > target).alias("b"), F.col("cumulative").alias("c"))
    best = summed.where(F.col("cumulative") < total).agg(F.min(key).alias("k")).select(F.col("k.c").alias("cut"))
    chosen = summed.join(F.broadcast(best)).select("prompt_sha256", F.when(F.col("cumulative") <= F.col("cut"), "validation").otherwise("train").alias("partition"))
    return retained.join(chosen, "prompt_sha256")


def leaks(split: DataFrame) -> DataFrame:
    """Prompts or records that are on both sides."""
    kinds = [split.groupBy(F.col(c).alias("sha256")).agg(F.count_distinct("partition").alias("sides")).where("sides > 1").withColumn("kind", F.lit(c)) for c in ("prompt_sha256", "record_sha256")]
    return kinds[0].unionByName(kinds[1])


def hash_remainder(salt: str, suite: Column, task: Column, modulus: int) -> Column:
    """The first 8 bytes of SHA-256(salt, suite, task) as an unsigned number, modulo."""
    digest = sha256(F.concat_ws("\0", F.lit(salt), suite, task))
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def hash_partition(tasks: DataFrame, *, salt: str, modulus: int, development: list[int], qualification_only: list[str] = ()) -> DataFrame:
    """tasks (suite, task_id) with remainder and partition development or qualification."""
    out = tasks.withColumn("remainder", hash_remainder(salt, F.col("suite"), F.col("task_id"), modulus))
    chosen = F.col("remainder").isin(list(development)) & ~F.col("suite").isin(list(qualification_only))
    return out.withColumn("partition", F.when(chosen, "development").otherwise("qualification"))


def frozen_membership_violations(frozen: DataFrame, tasks: DataFrame, **rule) -> DataFrame:
    """Tasks whose frozen partition is not the recomputed one, or that only one side has."""
    fresh = hash_partition(tasks, **rule).select("suite", "task_id", F.col("partition").alias("expected"))
    both = frozen.select("suite", "task_id", "partition").join(fresh, ["suite", "task_id"], "full_outer")
    return both.where(~F.col("partition").eqNullSafe(F.col("expected")))


def top_by_hash(df: DataFrame, salt: str, key: Column, k: int) -> DataFrame:
    """The k rows of the smallest salted hashes."""
    return df.withColumn("rank_sha256", sha256(F.concat_ws(":", F.lit(salt), key))).orderBy("rank_sha256").limit(k)


def quotas(sizes: DataFrame, count: int, *keys: str) -> DataFrame:
    """Largest-remainder quotas of the strata (keys, size): one row a stratum, few rows."""
    total = F.sum("size").over(Window.partitionBy())
    out = sizes.withColumn("_total", total).withColumn("_floor", F.expr(f"{count} * size div _total")).withColumn("_rest", F.expr(f"({count} * size) % _total"))
    left = F.lit(count) - F.sum("_floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), *keys))
    return out.withColumn("_left", left).withColumn("quota", (F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)).cast("long")).select(*keys, "size", "quota")


def stratified_sample(fingerprinted: DataFrame, *, count: int, seed: int, keys: tuple[str, ...] = ("source_id", "revision")) -> DataFrame:
    """`count` rows, each stratum's quota of them being those of its smallest hashes of (seed, input_index, record).

    The rank within a stratum is counted in two levels, so that a stratum of a third of all rows is many tasks.
    """
    rank = sha256(F.concat_ws("\0", F.lit(str(seed)), F.col("input_index").cast("string"), F.col("record_sha256")))
    rows = fingerprinted.withColumn("rank_sha256", rank).withColumn("_range", F.substring("rank_sha256", 1, 2))
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    wanted = starts.join(quotas(sizes.groupBy(*keys).agg(F.sum("n").alias("size")), count, *keys), list(keys))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("rank_sha256", "input_index"))
    # ranges that begin past the quota are dropped before they are ordered
    kept = rows.join(wanted.where("_start < quota"), [*keys, "_range"]).withColumn("_place", place)
    return kept.where(F.col("_start") + F.col("_place") <= F.col("quota")).drop("_range", "_start", "_place", "size", "quota")


def naive_split(rows: DataFrame, *, fraction: float, seed: int, key: str = "input_index") -> DataFrame:
    """rows with partition by a seeded order of single rows, whatever their prompts; exact sizes.

    The order is that of salted hashes; a shuffle by a generator of random numbers, which one process would have to run over all rows,
    is not offered here.
    """
    target = validation_target(rows.count(), fraction)
    order = sha256(F.concat_ws("\0", F.lit(str(seed)), F.col(key).cast("string")))
    out = running_total(rows, order, F.lit(1), "_place")
    return out.withColumn("partition", F.when(F.col("_place") <= target, "validation").otherwise("train")).drop("_place")
