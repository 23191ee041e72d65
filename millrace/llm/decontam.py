"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if the document has at least THRESHOLD of the item's distinct word
shingles.  Items are partitioned by size, powers of two.  Each partition has its own BANDS * BAND_ROWS
permutations; an item's sketch is its least shingle under each.  A document that has the share c of an item has its
least shingle under a permutation with probability c, however long the document is, so that short items are found in
long documents, where their Jaccard similarity is next to nothing.  A document large enough for an item's partition is a
candidate if it has all BAND_ROWS shingles of one of the item's bands: a pair at the threshold is missed with
probability (1 - THRESHOLD ** BAND_ROWS) ** BANDS, 2e-8, and less above it.  Only candidates' shingles are counted, exactly,
as text.

Items are taken in blocks of a bounded number of shingles: a benchmark of any size takes more passes, not more
memory.  An item of more shingles than a block holds is counted in several parts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frame, fresh, keyed, materialize, text_key

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of a sketch, and shingles in each.
BANDS, BAND_ROWS = 40, 2
#: Item shingles in a block, about.
BLOCK = 200_000
#: Rows of hits that are broadcast to drop documents; more of them are joined by a shuffle.
FEW = 100_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(words: list[str], k: int) -> set[str]:
    return set(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


_ITEM = T.StructType(
    [T.StructField("n_item", T.IntegerType()), T.StructField("all", T.ArrayType(T.StringType())), T.StructField("sketch", T.ArrayType(T.ArrayType(T.StringType())))]
)


def size_class(n: int) -> int:
    """The partition of an item of n shingles."""
    return n.bit_length() - 1


@cache
def _permutations(partition: int) -> np.ndarray:
    rng = np.random.default_rng([2, partition])
    return rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch_of(shingles: list[str]) -> list[list[str]]:
    """BANDS lists of the shingles that come first under the permutations of their number's partition."""
    if not shingles:
        return []
    times, plus = _permutations(size_class(len(shingles)))
    hashes = np.array([xxhash.xxh3_64_intdigest(s) for s in shingles], dtype=np.uint64)
    mixed = hashes[:, None] * times + plus
    first = ((mixed ^ (mixed >> np.uint64(32))) * times).argmin(axis=0).reshape(BANDS, BAND_ROWS)
    return [sorted({shingles[i] for i in band}) for band in first.tolist()]


@F.pandas_udf(_ITEM)
def _item_shingles(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = words_of(text or "")
        found = sorted(shingles_of(words, min(SHINGLE, len(words)))) if words else []
        rows.append((len(found), found, sketch_of(found)))
    return frame(rows, _ITEM.names)


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, ikey, n_item, piece, all, sketch) of every item (item_id, text), in pieces of BLOCK shingles at most.

    An item of fewer words than a shingle is one shingle of all its words; one without words has none.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_key().alias("ikey"), _item_shingles("text").alias("s"))
    rows = rows.where("s.n_item > 0").dropDuplicates(["item_id", "ikey"]).select("item_id", "ikey", "s.*")
    part = F.expr(f"transform(sequence(0, cast((n_item - 1) div {BLOCK} as int)), p -> struct(p as piece, slice(all, p * {BLOCK} + 1, {BLOCK}) as all))")
    return rows.select("item_id", "ikey", "n_item", "sketch", F.explode(part).alias("p")).select("item_id", "ikey", "n_item", "p.piece", "p.all", "sketch")


class Block(NamedTuple):
    """Pieces of items by number: sketches to search with, and shingles to count."""

    n_item: list[int]
    #: by the number of words in them: the shingles of all sketches, and for each the (piece, band) that it belongs to
    lookup: dict[int, dict[str, list[tuple[int, int]]]]
    bands: list[list[int]]
    pieces: list[set[str]]

    @classmethod
    def of(cls, rows: list) -> Block:
        lookup: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for i, row in enumerate(rows):
            for b, band in enumerate(row["sketch"]):
                for shingle in band:
                    lookup.setdefault(shingle.count(" ") + 1, {}).setdefault(shingle, []).append((i, b))
        return cls([r["n_item"] for r in rows], lookup, [[len(band) for band in r["sketch"]] for r in rows], [set(r["all"]) for r in rows])

    def search(self, words: list[str]) -> list[int]:
        """Candidates among the pieces, by their items' sketches alone."""
        found, large = set(), math.inf
        for k, shingles in self.lookup.items():
            own = shingles_of(words, k)
            if k == SHINGLE:
                large = len(own)
            hits: Counter[tuple[int, int]] = Counter()
            for shingle in shingles.keys() & own:
                hits.update(shingles[shingle])
            for (i, b), n in hits.items():
                # the least size of the partition, of which the document must have the share THRESHOLD
                enough = k < SHINGLE or large >= math.floor((1 << size_class(self.n_item[i])) * THRESHOLD)
                if n == self.bands[i][b] and enough:
                    found.add(i)
        return sorted(found)

    def count(self, words: list[str], candidates: list[int]) -> list[int]:
        """How many shingles of each candidate the words have."""
        own: dict[int, set[str]] = {}
        out = []
        for i in candidates:
            k = next(iter(self.pieces[i])).count(" ") + 1
            if k not in own:
                own[k] = shingles_of(words, k)
            out.append(len(self.pieces[i] & own[k]))
        return out


_FOUND = T.StructType([T.StructField("found", T.ArrayType(T.IntegerType())), T.StructField("shared", T.ArrayType(T.IntegerType()))])


def _search(block: Block):
    """UDF: the candidates of a text by their sketches, and for these alone the shingles that they share with it."""

    @F.pandas_udf(_FOUND)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text)
                found = block.search(words)
                rows.append((found, block.count(words, found)))
            yield frame(rows, _FOUND.names)

    return search


def _blocks(items: DataFrame) -> Iterator[list]:
    """The pieces of items, as rows, in blocks of about BLOCK shingles."""
    pieces = materialize(sketches(items), "items")
    total = pieces.agg(F.sum(F.size("all")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    for b in range(blocks):
        yield pieces.where(F.pmod(F.xxhash64("item_id", "ikey", "piece"), F.lit(blocks)) == b).collect()  # BLOCK shingles, about


def _candidates(rows: DataFrame, block: Block) -> DataFrame:
    """(doc_id, tkey, found, shared) of those rows (keyed()) that the search finds candidates for."""
    return rows.select("doc_id", "tkey", _search(block)("text").alias("s")).where(F.size("s.found") > 0).select("doc_id", "tkey", "s.*")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tkey, item_id, ikey): what the search finds, before any shingle is counted."""
    out = []
    for pieces in _blocks(items):
        names = F.array(*[F.struct(F.lit(r["item_id"]).cast("long").alias("item_id"), F.lit(r["ikey"]).alias("ikey")) for r in pieces] or [F.lit(None).cast("struct<item_id:long,ikey:long>")])
        found = _candidates(keyed(docs), Block.of(pieces)).select("doc_id", "tkey", F.explode("found").alias("i"))
        out.append(found.select("doc_id", "tkey", F.get(names, "i").alias("item")).select("doc_id", "tkey", "item.*"))
    return reduce(DataFrame.unionAll, out).distinct()


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, tkey, item_id, n_shared, n_item, containment for each document and each item it contains.

    Null texts have no words and neither contain nor are contained.  Rows or items that repeat another
    in id and text give no second row; rows of one id with several texts are documents of their own, and so are items.
    Texts of any length are read whole.  Ties do not arise: every item at the threshold or above is reported.
    An empty table on either side gives an empty result.
    """
    spark, parts = docs.sparkSession, []
    for pieces in _blocks(items):
        block = Block.of(pieces)
        hits = _candidates(keyed(docs), block)
        hits = hits.select("doc_id", "tkey", F.explode(F.arrays_zip("found", "shared")).alias("h")).select("doc_id", "tkey", "h.*").distinct()
        names = spark.createDataFrame([(i, r["item_id"], r["ikey"], r["n_item"], r["piece"]) for i, r in enumerate(pieces)], "found int, item_id long, ikey long, n_item int, piece int")
        parts.append(hits.join(F.broadcast(names), "found").drop("found"))  # a row for each piece of a block
    found = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "tkey", "item_id", "ikey", "n_item").agg(F.sum("shared").cast("long").alias("n_shared"))
    found = found.where(F.col("n_shared") >= F.ceil(F.round(F.col("n_item") * F.lit(THRESHOLD), 6)))
    return found.select("doc_id", "tkey", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that contain an item; all columns, and all other rows, stay.

    What null, empty, very long and repeated texts contain is said in contained_items().
    """
    id_, key = fresh(docs, "_mr_id"), fresh(docs, "_mr_key")
    hit = materialize(contained_items(docs, items).select(F.col("doc_id").alias(id_), F.col("tkey").alias(key)).distinct(), "hits")
    hit = F.broadcast(hit) if hit.count() <= FEW else hit
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit[id_]) & (text_key(docs["text"]) == hit[key]), "left_anti")
