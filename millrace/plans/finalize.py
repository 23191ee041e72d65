"""Finalising a distilled corpus: prefilter, the dataset pipeline, and a gate that only a clean check opens."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_markup
from ..operators import contamination, distill
from ..operators.checks import assert_empty
from . import merkle, pipeline


class Finalised(NamedTuple):
    prefiltered: DataFrame
    stages: pipeline.Stages
    status: str


def finalize(records: DataFrame, protected: DataFrame | None, *, most: int = 2048, fraction: float = 0.05, seed: int = 1729) -> Finalised:
    """records with finish_reason and quality_passed.  Reasoning markup left in a message is an error."""
    assert_empty(records.where(has_markup(F.col("messages"))).select("input_index"), "messages hold reasoning markup")
    marked = distill.prefilter(records)
    stages = pipeline.prepare(marked.where("prefilter_reason is null"), most=most, protected=protected, fraction=fraction, seed=seed)
    return Finalised(marked, stages, contamination.status(stages.findings))


def require_clean(done: Finalised) -> DataFrame:
    """The split to be written; anything but a clean contamination check is an error."""
    if done.status != "clean":
        raise ValueError(f"contamination is {done.status}, not clean")
    return done.stages.split


def corpus_manifest(composition, split: DataFrame, git_clean: bool) -> tuple[dict, DataFrame]:
    """(document, blocks) of a frozen corpus; anything in corpus_problems() is an error.

    The document has the stats of each source and of each partition its rows and the root of its digest tree.  blocks
    (partition, block, n, sha256) are the trees' leaves, by which a later check finds what changed.
    """
    if problems := corpus_problems(composition, git_clean):
        raise ValueError(f"the corpus cannot be frozen: {', '.join(problems)}")
    blocks, parts = None, {}
    for (name,) in split.select("partition").distinct().orderBy("partition").collect():  # as many as partitions
        tree = merkle.digest_tree(split.where(F.col("partition") == name))
        parts[name] = merkle.root(tree).first().asDict()
        leaves = tree.where("level = 0").select(F.lit(name).alias("partition"), F.col("node").alias("block"), "n", "sha256")
        blocks = leaves if blocks is None else blocks.unionByName(leaves)
    if sum(p["n"] for p in parts.values()) != composition.accepted.count():
        raise ValueError("the partitions are not the accepted records")
    return {"schema_version": 1, "sources": [r.asDict() for r in composition.stats.orderBy("source_order").collect()], "partitions": parts, "contamination": {"status": "not_run"}}, blocks


def corpus_problems(composition, git_clean: bool) -> list[str]:
    """What keeps a composed corpus from being frozen: shortfalls, copies among the accepted rows, unsaved code."""
    short = composition.stats.where("accepted < requested").count()
    copies = composition.accepted.groupBy("record_sha256").count().where("count > 1").isEmpty()
    return [p for p, bad in (("shortfall", short > 0), ("duplicates", not copies), ("unclean_repository", not git_clean)) if bad]
