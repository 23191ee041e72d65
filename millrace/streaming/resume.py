"""Resumable ingestion: a stream whose checkpoint remembers what has been done.

A shard of work is a file of the input folder; each run takes what is new (availableNow), and a batch
that is replayed after a failure writes its folder again, so that each row is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256


class RunIdentityError(ValueError):
    """A run would go on with other settings than it began with."""


def check_identity(spark: SparkSession, folder: str, identity: str) -> None:
    """Write the digest of a run's configuration beside its output, or compare it with the one there."""
    digest = spark.range(1).select(sha256(F.lit(identity)).alias("h")).first()["h"]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_identity")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(path):
        found = spark.read.text(str(path)).first()[0]
        if found != digest:
            raise RunIdentityError(f"{folder} was begun as {found}, not {digest}")
        return
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(str(path))


def ingest(spark: SparkSession, source: str, schema: str, folder: str, transform: Callable[[DataFrame], DataFrame], *, identity: str, fmt: str = "json", files_per_batch: int = 1) -> int:
    """Take all new files of source through transform into folder/data/batch=N; the number of batches that ran."""
    check_identity(spark, folder, identity)
    done = []

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/data/batch={number}")
        done.append(number)

    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def ingested(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data")


def append_responses(rows: DataFrame, path: str) -> None:
    """Append-only checkpoint of generated rows (item_id, prompt_sha256, response)."""
    rows.write.mode("append").json(path)


def generate(rows: DataFrame, backend: Callable[[list[str], list[int]], list[str]], seed: int = 0, batch: int = 64) -> DataFrame:
    """rows (item_id, prompt) with response: the batch inference hook, a call for each `batch` rows of a task."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                seeds = [seed + int(i) for i in part["item_id"]]
                yield part[["item_id"]].assign(response=backend(part["prompt"].tolist(), seeds))

    made = rows.select("item_id", "prompt").mapInPandas(run, "item_id long, response string")
    return rows.join(made, "item_id")
