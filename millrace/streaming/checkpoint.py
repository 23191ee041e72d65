"""An append-only checkpoint of generated rows: batches that can be written again, torn lines set aside, the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_object, json_string
from ..sources.jsonl import numbered_lines

ROW = "item_id long, prompt_sha256 string, response string"


def checkpoint_line(item_id="item_id", prompt="prompt_sha256", response="response"):
    text = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    return json_object(item_id=F.col(item_id).cast("string"), prompt_sha256=text(prompt), response=text(response))


def append_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """Append rows (ROW) as a batch.  A batch that is appended again, after a failure, replaces itself and nothing else."""
    rows.select(checkpoint_line().alias("value")).write.mode("overwrite").text(f"{folder}/batch={batch:010d}")


def scan_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, file_path, line_number, line, item_id, prompt_sha256, response, problem) of every line.

    problem: torn for a last line of a file that does not parse, as a writer leaves it that died; bad_line for any other, which
    is no accident of appending; and blank_line.
    """
    lines = numbered_lines(spark, f"{folder}/batch=*")
    ends = lines.groupBy("file_path").agg(F.max("line_number").alias("_last"))
    parsed = lines.join(ends, "file_path").withColumn("r", F.from_json("line", ROW, {"mode": "PERMISSIVE"}))
    whole = F.coalesce(F.array_sort(F.json_object_keys("line")) == F.array(*[F.lit(k) for k in ("item_id", "prompt_sha256", "response")]), F.lit(False)) & F.col("r.item_id").isNotNull()
    problem = F.when(F.trim("line") == "", "blank_line").when(~whole & (F.col("line_number") == F.col("_last")), "torn").when(~whole, "bad_line")
    batch = F.regexp_extract("file_path", r"/batch=(\d+)/", 1).cast("long")
    return parsed.select(batch.alias("batch"), "file_path", "line_number", "line", "r.*", problem.alias("problem"))


def read_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, prompt_sha256, response, batch): of each item what the last batch says, and in it the last line of the last file.

    Torn lines are left aside; any other line that does not parse is an error.
    """
    from ..operators.checks import assert_empty

    lines = scan_checkpoint(spark, folder)
    assert_empty(lines.where("problem in ('bad_line', 'blank_line')").select("file_path", "line_number"), f"{folder} holds lines that are no rows")
    latest = F.max_by(F.struct("prompt_sha256", "response", "batch"), F.struct("batch", "file_path", "line_number"))
    return lines.where("problem is null").groupBy("item_id").agg(latest.alias("r")).select("item_id", "r.*")
