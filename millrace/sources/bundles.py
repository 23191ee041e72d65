"""Zip bundles of evidence: executors read their members through a data source, hash them, and everything they claim is recomputed.

A bundle lies in a folder that driver and executors see under one path, since zip needs to seek.  Members are dealt to tasks
by their place, so that no process lists or unpacks a whole bundle.
"""

from __future__ import annotations

import hashlib
import os
import stat
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a bundle for each task that reads it, and of a piece of a member that is held at once.
SPLIT, PIECE = 32 << 20, 1 << 20
#: Sidecars are one short line; no more of a member that says it is one is read as text.
SIDECAR_BYTES = 4096
MEMBER = "bundle string, name string, bytes long, sha256 string, problem string, sidecar string"
LINE = "bundle string, name string, line_number long, line string"


def local_path(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: a bundle must lie in a folder that all processes see as files")
    return unquote(parsed.path)


class _Share(InputPartition):
    def __init__(self, path: str, share: int, shares: int):
        super().__init__(None)
        self.path, self.share, self.shares = path, share, shares


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.suffix, self.split = options["paths"].split("\n"), options.get("lines"), int(options["split"])

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            shares = max(1, -(-os.path.getsize(path) // self.split))
            out += [_Share(path, i, shares) for i in range(shares)]
        return out or [_Share("", 0, 1)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        if not partition.path:
            return
        title = os.path.basename(partition.path)
        with zipfile.ZipFile(partition.path) as bundle:
            for i, member in enumerate(bundle.infolist()):
                if i % partition.shares == partition.share and not member.is_dir():
                    yield from self._lines(bundle, title, member) if self.suffix else [self._facts(bundle, title, member)]

    def _facts(self, bundle: zipfile.ZipFile, title: str, member: zipfile.ZipInfo) -> tuple:
        name, path = member.filename, PurePosixPath(member.filename)
        problem = None
        if path.is_absolute() or ".." in path.parts or "\\" in name or path.as_posix() != name:
            problem = "unsafe_path"
        elif stat.S_ISLNK(member.external_attr >> 16):
            problem = "link"
        digest, size, head = hashlib.sha256(), 0, b""
        try:
            with bundle.open(member) as data:
                while piece := data.read(PIECE):
                    head = head or piece[:SIDECAR_BYTES]
                    digest.update(piece)
                    size += len(piece)
        except (zipfile.BadZipFile, EOFError, OSError):
            return title, name, size, None, problem or "damaged", None
        return title, name, size, digest.hexdigest(), problem, head.decode("ascii", "replace") if name.endswith(".sha256") else None

    def _lines(self, bundle: zipfile.ZipFile, title: str, member: zipfile.ZipInfo) -> Iterator[tuple]:
        if member.filename.endswith(self.suffix):
            with bundle.open(member) as data:
                for number, line in enumerate(data, 1):
                    yield title, member.filename, number, line.decode("utf-8", "replace").rstrip("\n")


class BundleSource(DataSource):
    """Members of zip bundles: name, size, digest and what is wrong with each; with `lines`, the lines of members of that suffix."""

    @classmethod
    def name(cls) -> str:
        return "millrace_bundle"

    def schema(self) -> str:
        return LINE if self.options.get("lines") else MEMBER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_bundles(spark: SparkSession, path: str, lines: str | None = None, split: int = SPLIT) -> DataFrame:
    """Members (MEMBER) of the bundles of a folder or glob, or with a suffix, such as .jsonl, the lines (LINE) of those members.

    split: bytes of a bundle for each task.
    """
    spark.dataSource.register(BundleSource)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path").collect()  # a row for each bundle
    reader = spark.read.format("millrace_bundle").option("paths", "\n".join(sorted(local_path(r.path) for r in found))).option("split", split)
    return (reader.option("lines", lines) if lines else reader).load() if found else spark.createDataFrame([], LINE if lines else MEMBER)


def bundle_findings(members: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(bundle, name, bytes, sha256, problem) of all members that are no sidecars; problem is null where all claims hold.

    In this order: unsafe_path, link, damaged, repeated_path, no_sidecar, sidecar_format (not one line of digest, two spaces and a
    name), sidecar_elsewhere (another folder's file, or another file), digest_differs; with a manifest (bundle, name, sha256,
    bytes): not_in_manifest, manifest_differs.  Sidecars without a payload are rows with missing_payload, and files that only the
    manifest has, with missing.
    """
    each = members.withColumn("_stem", F.when(F.col("sidecar").isNotNull(), F.expr("left(name, length(name) - 7)")).otherwise(F.col("name")))
    payload = each.where("sidecar is null").groupBy("bundle", "_stem").agg(
        F.count("*").alias("_n"), F.min("name").alias("name"), F.max("bytes").alias("bytes"), F.max("sha256").alias("sha256"), F.max("problem").alias("_own")
    )
    claims = each.where("sidecar is not null").groupBy("bundle", "_stem").agg(F.max("sidecar").alias("_claim"), F.max("name").alias("_claimed_by"), F.max("problem").alias("_its"))
    both = payload.join(claims, ["bundle", "_stem"], "full_outer")
    digest, file = F.regexp_extract("_claim", r"\A([0-9a-f]{64})  ([^\n]+)\n\z", 1), F.regexp_extract("_claim", r"\A([0-9a-f]{64})  ([^\n]+)\n\z", 2)
    problem = (
        F.when(F.col("name").isNull(), F.coalesce("_its", F.lit("missing_payload"))).when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_n") > 1, "repeated_path").when(F.col("_claim").isNull(), "no_sidecar")
        .when(digest == "", "sidecar_format").when(file != F.substring_index("_stem", "/", -1), "sidecar_elsewhere").when(digest != F.col("sha256"), "digest_differs")
    )
    out = both.select("bundle", F.coalesce("name", "_claimed_by").alias("name"), "bytes", "sha256", problem.alias("problem"))
    if manifest is None:
        return out
    listed = manifest.select("bundle", "name", F.col("sha256").alias("_sha256"), F.col("bytes").alias("_bytes"))
    joined = out.join(listed, ["bundle", "name"], "full_outer")
    differs = ~F.col("sha256").eqNullSafe(F.col("_sha256")) | ~F.col("bytes").eqNullSafe(F.col("_bytes"))
    found = F.col("sha256").isNotNull() | F.col("problem").isNotNull()
    against = F.when(~found, "missing").when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_sha256").isNull(), "not_in_manifest").when(differs, "manifest_differs")
    return joined.select("bundle", "name", "bytes", "sha256", against.alias("problem"))


def write_bundles(files: DataFrame, folder: str, bundle: str = "bundle") -> DataFrame:
    """(bundle, members): zip bundles of files (bundle, name, content, mode), one for each bundle, in the order of names.

    A bundle is written by one task, as a stream, beside its place and then moved there, so a task that runs again leaves one
    file.  A null mode is a plain file's.  Dates are fixed: equal files make equal bundles.
    """
    where = local_path(folder)

    def write(batches):
        import pandas as pd

        os.makedirs(where, exist_ok=True)
        current, out, temporary, counts = None, None, None, {}

        def close():
            if out is not None:
                out.close()
                os.replace(temporary, f"{where}/{current}.zip")

        for pdf in batches:
            for title, name, content, mode in zip(pdf[bundle], pdf["name"], pdf["content"], pdf["mode"], strict=True):
                if title != current:
                    close()
                    current, temporary = title, f"{where}/.{title}.{uuid.uuid4().hex}.tmp"
                    out = zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED)
                entry = zipfile.ZipInfo(name)
                entry.filename = name  # as given, also where a reader must refuse it
                entry.external_attr = int(stat.S_IFREG | 0o644 if pd.isna(mode) else mode) << 16
                out.writestr(entry, bytes(content), zipfile.ZIP_DEFLATED)
                counts[title] = counts.get(title, 0) + 1
        close()
        yield pd.DataFrame({"bundle": pd.Series(list(counts), dtype=object), "members": pd.Series(list(counts.values()), dtype="int64")})

    rows = files.select(bundle, "name", "content", F.col("mode").cast("long").alias("mode")).repartition(bundle).sortWithinPartitions(bundle, "name")
    return rows.mapInPandas(write, "bundle string, members long")
