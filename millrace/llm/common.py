"""What the operators share: keys, the shared work folder, tables written there, components."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()
#: Rows of an Arrow batch: texts may be long, and a Python worker and the JVM each hold a batch whole.
BATCH = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir of the session.

    Where the session has none, a temporary folder is set as its checkpoint folder if driver and executors are one
    process (a local master); elsewhere it is an error, since a machine-local folder is not shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there.

    checkpoint() would compute the plan twice; a written table costs one pass and outlives executors.
    """
    path = f"{shared_dir(df.sparkSession)}/millrace-{name}-{uuid.uuid4().hex}-{next(_serial)}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Columns of plain objects, which Arrow converts to the declared types whatever their length."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns, strict=True)})


def text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tkey): the document, null text as empty, and the hash that tells texts apart.

    The session's Arrow batches are set to BATCH rows.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tkey", text_key())


def on_key(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of (doc_id, tkey)."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tkey"] == right["tkey"])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges (u, v: same type, undirected).

    Alternating large-star and small-star steps: each is one aggregation and one join, so that a hub
    with any number of links stays a sum and a join whose rows Spark can split.  Each round is written
    to the shared folder; rounds end when the links no longer change.  Self links and repeats are fine.
    """
    spark = edges.sparkSession
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(links, "links")
    before = _checksum(current)
    for _ in range(most):
        if not before[0]:
            break
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(current)
        current, now = after, _checksum(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
