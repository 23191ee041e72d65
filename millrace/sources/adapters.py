"""Views of plain tables as the engine's records, protected examples and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import single_turn
from ..registry import SOURCES
from ..schema import MESSAGES, VALIDATION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _provenance(source, record_id, revision="r1", license_name="synthetic"):
    null = F.lit(None).cast("string")
    terms = F.struct(F.lit(license_name).alias("name"), null.alias("url"), null.alias("attribution"))
    return F.struct(
        source.alias("source_id"), F.lit(revision).alias("revision"), terms.alias("license"), null.alias("split"),
        record_id.cast("string").alias("record_id"), null.alias("url"), F.create_map().cast("map<string,string>").alias("source_metadata"),
    )


def document_records(documents: DataFrame) -> DataFrame:
    """One record a document: the first line asks, the text answers."""
    return documents.select(
        F.col("doc_id").alias("input_index"), F.lit(1).alias("schema_version"),
        single_turn(F.substring_index("text", "\n", 1), F.col("text")).alias("messages"), F.col("lang").alias("language"),
        _provenance(F.col("source"), F.col("doc_id")).alias("provenance"), F.lit(None).cast(VALIDATION).alias("validation"),
    )


def conversation_records(conversations: DataFrame) -> DataFrame:
    """One record a conversation, its messages by turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select(
        F.col("conv_id").alias("input_index"), F.lit(1).alias("schema_version"), messages.cast(MESSAGES).alias("messages"), F.lit("text").alias("language"),
        _provenance(F.lit("conversations"), F.col("conv_id")).alias("provenance"), F.lit(None).cast(VALIDATION).alias("validation"),
    )


SOURCES.add("documents", lambda spark, folder: document_records(table(spark, folder, "documents")))
SOURCES.add("conversations", lambda spark, folder: conversation_records(table(spark, folder, "conversations")))


def source_records(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The records of a registered source."""
    return SOURCES.get(name)(spark, folder)


def paired_outcomes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """suite, task_id, base_passed, candidate_passed."""
    rows = labels.join(documents.select("doc_id", "lang"), "doc_id")
    return rows.select(F.col("lang").alias("suite"), F.col("doc_id").cast("string").alias("task_id"), (F.col("quality") == 1).alias("base_passed"), (F.col("toxic") == 0).alias("candidate_passed"))


def repeated_runs(events: DataFrame) -> DataFrame:
    """run (day), task_id (user), passed: some purchase-sized value that day; only users seen on every day."""
    runs = events.groupBy(F.to_date("ts").alias("run"), F.col("user_id").cast("string").alias("task_id")).agg((F.max("value") > 50).alias("passed"))
    days = runs.agg(F.count_distinct("run").alias("days"))
    full = runs.groupBy("task_id").agg(F.count("*").alias("n")).join(F.broadcast(days), F.col("n") == F.col("days"), "left_semi")
    return runs.join(full, "task_id", "left_semi")
