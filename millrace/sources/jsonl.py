"""Strict JSONL scans, benchmark and hub scans, and sinks."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import stat
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shapes import fault, first_fault
from ..functions.text import is_blank, json_array, json_object, json_string
from ..operators.checks import assert_empty, membership_drift, repeated_keys
from ..schema import LINE, RECORD_SHAPE
from ..work import written


#: Blocks of files whose first lines are broadcast; more of them are joined by a shuffle.
FEW_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(input_index, line_number, file_path, line): a task reads blocks of files, each in order, and the blocks' counts place them."""
    block = ["file_path", "file_block_start"]
    lines = spark.read.text(path).select(*[f"_metadata.{c}" for c in block], F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    sizes = lines.groupBy(*block).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    within = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0))
    places = written(sizes.select(*block, (total(before) - F.col("_low")).alias("_start"), (total(within) - F.col("_low")).alias("_line")), "blocks")
    placed = lines.join(F.broadcast(places) if places.count() <= FEW_BLOCKS else places, block)
    return placed.select((F.col("_start") + F.col("_at")).alias("input_index"), (F.col("_line") + F.col("_at") + 1).alias("line_number"), "file_path", "line")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """input_index, line_number, line, record fields, bad_encoding, and path and `problem` of the first fault of every line: nothing is dropped.

    Lines with a fault have no fields.

    The index counts all lines from 0 in the order of file names and of lines within a file, however files are dealt to
    tasks; line_number counts those of a file from 1.
    """
    lines = numbered_lines(spark, path)
    # through explode(), so that a line is walked once, not once for each use of what is found
    walked = lines.withColumn("_f", F.explode(F.array(F.when(is_blank(F.col("line")), fault(F.lit(""), "blank_line")).otherwise(first_fault(F.col("line"), RECORD_SHAPE)))))
    whole = F.when(F.col("_f").isNull(), F.col("line"))
    parsed = walked.withColumn("r", F.from_json(whole, LINE, {"mode": "PERMISSIVE"}))
    pairs = F.transform("r.provenance.source_metadata", lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))
    provenance = F.col("r.provenance").withField("source_metadata", F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))))
    # a lone surrogate is lost in parsing, so it is looked for in the line
    lone = F.col("line").rlike(r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}")
    return parsed.select(
        "input_index", "line_number", "line", "r.schema_version", "r.messages", "r.language", F.when(F.col("r.provenance").isNotNull(), provenance).alias("provenance"), "r.validation",
        lone.alias("bad_encoding"), F.col("_f.path").alias("path"), F.col("_f.reason").alias("problem"),
    )


def load_records(spark: SparkSession, path: str, language: str) -> DataFrame:
    """The records of a file; any problem, another language, or no row at all is an error."""
    rows = scan_records(spark, path)
    assert_empty(rows.where("problem is not null").select("line_number", "path", "problem"), f"{path} is not a record file")
    assert_empty(rows.where(~F.coalesce(F.col("language") == language, F.lit(False))).select("input_index", "language"), f"{path} holds records that are not {language}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no records")
    return rows.drop("line", "line_number", "path", "problem")


def hub_scan(spark: SparkSession, path: str, predicate: Column, mapping: dict[str, Column], fmt: str = "parquet", limit: int | None = None, order: str = "input_index") -> DataFrame:
    """Rows of a hub dataset by an equality predicate, nested or not, which the scan can push down, and their fields.

    limit: the first rows by `order`, where a bounded load is asked for.
    """
    rows = spark.read.format(fmt).load(path).where(predicate).select(*[c.alias(n) for n, c in mapping.items()])
    return rows if limit is None else rows.orderBy(order).limit(limit)


def benchmark_violations(items: DataFrame, count: int, first: int = 0) -> DataFrame:
    """Ids that a benchmark of `count` contiguous ids lacks, has too many of, or repeats."""
    wanted = items.sparkSession.range(first, first + count).select(F.col("id").alias("item_id"))
    drift = membership_drift(wanted, items, "item_id")
    return drift.unionByName(repeated_keys(items, "item_id").select("item_id", F.lit("repeated").alias("side")))


def protected_union(examples: dict[str, DataFrame], registered: list[str]) -> DataFrame:
    """All protected examples; a registered benchmark without a loader is an error."""
    missing = sorted(set(registered) - examples.keys())
    if missing:
        raise ValueError(f"no loader for {', '.join(missing)}")
    return reduce(DataFrame.unionByName, [examples[k] for k in registered])


def scan_results(spark: SparkSession, path: str, schema: str, key: str = "problem_id") -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    assert_empty(repeated_keys(rows, key), f"{path} repeats {key}")
    return rows


# --- sinks -----------------------------------------------------------------------------------------------


def record_line(df: DataFrame) -> Column:
    """Canonical JSON of a record: keys in order, compact, nulls of provenance kept, empty validation left out."""
    p = "provenance."
    text = lambda c: F.coalesce(json_string(F.col(c)), F.lit("null"))
    terms = json_object(name=text(p + "license.name"), url=text(p + "license.url"), attribution=text(p + "license.attribution"))
    entries = F.array_sort(F.map_entries(p + "source_metadata"))
    metadata = json_array(F.transform(entries, lambda e: json_array(F.array(json_string(e["key"]), json_string(e["value"])))))
    provenance = json_object(
        source_id=text(p + "source_id"), revision=text(p + "revision"), license=terms, split=text(p + "split"), record_id=text(p + "record_id"), url=text(p + "url"),
        source_metadata=F.coalesce(metadata, F.lit("[]")),
    )
    result = lambda r: json_object(validator_id=json_string(r["validator_id"]), passed=r["passed"].cast("string"), detail=F.coalesce(json_string(r["detail"]), F.lit("null")))
    validation = F.coalesce(json_object(results=json_array(F.transform("validation.results", result))), F.lit("null"))
    messages = json_array(F.transform("messages", lambda m: json_object(role=json_string(m["role"]), content=json_string(m["content"]))))
    return json_object(schema_version=F.col("schema_version").cast("string"), messages=messages, language=text("language"), provenance=provenance, validation=validation)


def write_records(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One canonical JSON line a record, in the order of input_index across the part files, or a folder for each partition.

    Spark commits the folder as a whole.
    """
    lines = df.select(record_line(df).alias("value"), "input_index", *([partition] if partition else []))
    if partition:
        lines.drop("input_index").write.partitionBy(partition).text(path)
    else:
        lines.repartitionByRange(F.col("input_index")).sortWithinPartitions("input_index").select("value").write.text(path)


def write_split(df: DataFrame, path: str, partition: str = "partition") -> None:
    """A folder of canonical JSON lines for each partition, in the order of input_index across its files, and an index of them.

    Rows are dealt by ranges of (partition, input_index) and sorted, so a partition's files are in its order by their names.  The
    index, path.index, has (partition, file_path, first, rows): the place of each file's first line and how many it has.
    """
    lines = df.select(partition, "input_index", record_line(df).alias("value"))
    lines.repartitionByRange(partition, "input_index").sortWithinPartitions(partition, "input_index").drop("input_index").write.partitionBy(partition).text(path)
    files = df.sparkSession.read.text(path).groupBy(partition, F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy(partition).orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files.select(F.col(partition).alias("partition"), "file_path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "rows").write.parquet(f"{path}.index")


def read_split(spark: SparkSession, path: str, partition: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(place, line) of a partition in the order in which it was written, from place `first` on; only files that hold these are read."""
    index = spark.read.parquet(f"{path}.index").where(F.col("partition") == partition).where(F.col("first") + F.col("rows") > first)
    if count is not None:
        index = index.where(F.col("first") < first + count)
    files = [r.file_path for r in index.orderBy("file_path").collect()]
    if not files:
        return spark.createDataFrame([], "place long, line string")
    lines = numbered_lines(spark, files).join(F.broadcast(index.select("file_path", "first")), "file_path")
    placed = lines.select((F.col("first") + F.col("line_number") - 1).alias("place"), "line")
    return placed.where(F.col("place") >= first) if count is None else placed.where(F.col("place").between(first, first + count - 1))


def write_document(document: dict, path: str) -> str:
    """A small JSON document and its checksum sidecar, each by a temporary file and a rename; the digest."""
    body = (json.dumps(document, sort_keys=True, indent=2, ensure_ascii=True) + "\n").encode()
    digest = hashlib.sha256(body).hexdigest()
    for target, data in ((path, body), (f"{path}.sha256", f"{digest}  {os.path.basename(path)}\n".encode())):
        with open(f"{target}.tmp", "wb") as out:
            out.write(data)
        os.replace(f"{target}.tmp", target)
    return digest


# --- bundles ---------------------------------------------------------------------------------------------


def bundle_problems(path: str) -> list[tuple[str, str]]:
    """(name, problem) of a zip bundle: unsafe paths, links, and members whose .sha256 sidecar is absent or differs."""
    out = []
    with zipfile.ZipFile(path) as bundle:
        members = {m.filename: m for m in bundle.infolist() if not m.is_dir()}
        for name, member in sorted(members.items()):
            if name.startswith("/") or "\\" in name or posixpath.normpath(name) != name or name.split("/")[0] == "..":
                out.append((name, "unsafe_path"))
            elif stat.S_ISLNK(member.external_attr >> 16):
                out.append((name, "link"))
            elif not name.endswith(".sha256"):
                sidecar = members.get(f"{name}.sha256")
                if sidecar is None:
                    out.append((name, "no_sidecar"))
                elif bundle.read(sidecar).split()[:1] != [hashlib.sha256(bundle.read(member)).hexdigest().encode()]:
                    out.append((name, "digest_differs"))
    return out


def inventory_drift(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Files of a folder whose digest is not the expected one (name, sha256), or that only one side has."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = folder.rstrip("/") + "/"
    name = F.substring(F.col("path"), F.instr("path", top) + len(top), F.lit(1 << 30))  # within the folder, folders below it included
    found = files.select(name.alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(found, "name", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("found")))
