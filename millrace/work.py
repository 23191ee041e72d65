"""Work tables: written once to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Without one, a temporary folder on a local master, and an error elsewhere."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; whoever writes it makes it."""
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


#: Tables that this process has written and not discarded.
_tables: list[DataFrame] = []


#: Whether a query's shuffle files go when it ends; by default when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False, **options: str) -> DataFrame:
    """df as a table of the shared folder: computed once, whoever reads it, and not lost with an executor.

    tidy: the shuffle files that it took are deleted at once.
    """
    path, conf = work_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if tidy:
        conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if tidy:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    _tables.append(out)
    return out


def clear() -> None:
    """Delete all tables of written() that this process still has: for the end of a job, when results have been stored."""
    tables, _tables[:] = list(_tables), []
    discard(*tables)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of written() that nothing reads any more; anything else is left alone."""
    _tables[:] = [t for t in _tables if not any(t is d for d in tables)]
    for df in tables:
        if path := getattr(df, "_millrace_path", None):
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def placed(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with `name`, the place of each row in the order, from 0.

    Rows are dealt by ranges of the order and sorted within each; the ranges' counts, a row for each, place them.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "placed")
    sizes = rows.groupBy("_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_start"))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")
