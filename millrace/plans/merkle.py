"""Digest trees of datasets, whose comparison goes down only where digests differ.

Level 0 digests blocks of WIDTH positions; each level above digests FANOUT nodes of the one below.  Two datasets that differ
in a few records differ in one path a record; only their blocks are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..work import written

WIDTH, FANOUT = 1024, 64
#: Differing nodes of a level that are broadcast (counted); more are joined by a shuffle.
MANY = 100_000
#: Blocks whose ranges are put into the scan's filter; more are found by a join.
FEW = 200


def _digest(place: str, value: str) -> Column:
    """Of at most WIDTH or FANOUT (place, value) pairs, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place), F.col(value))))
    return sha256(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p[place].cast("string"), p[value])), ","))


def digest_tree(hashed: DataFrame, index: str = "input_index", hash_: str = "record_sha256") -> DataFrame:
    """(level, node, n, sha256) of all levels up to one root; a written table.

    Positions may have gaps, and records at one position are digested in the order of their hashes.  Empty data has no nodes.
    """
    level = written(hashed.select(F.floor(F.col(index) / WIDTH).cast("long").alias("node"), F.col(index).alias("at"), F.col(hash_).alias("hash")).groupBy("node").agg(F.count("*").alias("n"), _digest("at", "hash").alias("sha256")), "tree-0")
    levels = [level.withColumn("level", F.lit(0))]
    span = level.agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
    low, high = span.low or 0, span.high or 0
    while low != high:
        level = written(level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("node"), F.lit(1)).agg(F.sum("n").alias("n"), _digest("node", "sha256").alias("sha256")).select("node", "n", "sha256"), f"tree-{len(levels)}")
        levels.append(level.withColumn("level", F.lit(len(levels))))
        low, high = low // FANOUT, high // FANOUT
    return reduce(DataFrame.unionByName, levels).select("level", "node", "n", "sha256")


def root(tree: DataFrame) -> DataFrame:
    """One row (n, sha256) of a tree; no row of empty data."""
    return tree.orderBy(F.desc("level")).limit(1).select("n", "sha256")


def differing_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node) of the blocks whose digests differ, found from the roots down: children are compared only below nodes that differ."""
    top = max(d.agg(F.max("level")).first()[0] or 0 for d in (left, right))
    suspects = None
    for level in range(top, -1, -1):
        sides = [d.where(F.col("level") == level).select("node", F.col("sha256").alias(name)) for d, name in ((left, "a"), (right, "b"))]
        if suspects is not None:
            above = suspects.withColumnRenamed("node", "_up")
            above = F.broadcast(above) if found <= MANY else above
            sides = [s.join(above, F.floor(s["node"] / FANOUT) == above["_up"], "left_semi") for s in sides]
        both = sides[0].join(sides[1], "node", "full_outer")
        suspects = written(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "suspects")
        if not (found := suspects.count()):
            break
    return suspects


def record_drift(left: DataFrame, right: DataFrame, blocks: DataFrame, index: str = "input_index", hash_: str = "record_sha256") -> DataFrame:
    """(index, problem) of the records of those blocks: missing, unexpected or changed.  Of other blocks nothing is read.

    Ranges of few blocks are a filter of the scan, which skips what lies outside by the files' statistics.
    """
    nodes = [r.node for r in blocks.limit(FEW + 1).collect()]

    def within(df: DataFrame) -> DataFrame:
        if len(nodes) <= FEW:
            return df.where(reduce(Column.__or__, [F.col(index).between(n * WIDTH, n * WIDTH + WIDTH - 1) for n in nodes], F.lit(False)))
        return df.join(blocks, F.floor(df[index] / WIDTH) == blocks["node"], "left_semi")

    a, b = within(left).select(index, F.col(hash_).alias("a")), within(right).select(index, F.col(hash_).alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("changed")
    return a.join(b, index, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(index, problem.alias("problem"))
