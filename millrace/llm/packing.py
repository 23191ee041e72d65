"""Best-two-fit packing of tokenised documents into sequences.

A document's length is all that packing looks at, and there are at most 2048 lengths: the histogram of
lengths, however many documents it counts, is what the bins are planned on.  The plan is exact for all
pieces: a step of it closes as many equal bins as the counts allow.  Pieces then find their
place by their rank among the pieces of their length, which two levels of counts give without bringing a
length's pieces together.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, materialize

CAPACITY = 2048
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 0
#: Groups by which ranks are counted; each has its share of every length.
GROUPS = 1024

PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField("tkey", T.LongType()), T.StructField("piece", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
)


class Encoder:
    """Token ids of whole texts, as `tokenizers` gives them for the vocabulary file.

    The same vocabulary is read as ranks by tiktoken, which is four times faster; texts that hold the name of a
    special token, which only the former reads as one token, are left to `tokenizers`.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids; of a long one the first may be shorter."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def _tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encoder = Encoder()
    end = np.array([END_ID], dtype="<u4").tobytes()
    for batch in batches:
        rows = []
        for doc_id, tkey, text in zip(batch["doc_id"].astype("Int64"), batch["tkey"], batch["text"], strict=True):
            rows += [(doc_id, tkey, i, *piece) for i, piece in enumerate(cut(encoder.encode(text) + end))]
        out = pd.DataFrame(rows, columns=PIECES.names)
        yield out.assign(doc_id=out["doc_id"].astype("Int64"))


def tokenized_pieces(docs: DataFrame) -> DataFrame:
    rows = keyed(docs)
    return rows.mapInPandas(_tokenize, PIECES)


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how many equal bins, lengths in each) that hold counts[n] pieces of every length n.

    Best-two-fit: a bin takes the longest piece left, then the longest that fits, again and again;
    then its smallest piece gives way to the two unpacked pieces that fill the gap so widened more tightly.
    """
    left = counts.astype(np.int64).copy()
    plan: list[tuple[int, list[int]]] = []
    sizes = np.arange(capacity + 1)
    top = capacity
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if not top:
            return plan
        #: the longest length left that is at most n
        fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        bin_, room = [top], capacity - top
        left[top] -= 1
        while room and (best := _longest(left, fits, room)):
            bin_.append(best)
            left[best] -= 1
            room -= best
        if room and len(bin_) > 1:
            small = bin_[-1]
            pair = _two(left, room + small, small)
            if pair:
                left[small] += 1
                for n in pair:
                    left[n] -= 1
                bin_[-1:] = sorted(pair, reverse=True)
        used: dict[int, int] = {}
        for n in bin_:
            used[n] = used.get(n, 0) + 1
        again = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= again * k
        plan.append((again + 1, bin_))


def _longest(left: np.ndarray, fits: np.ndarray, room: int) -> int:
    best = int(fits[room])
    while best and not left[best]:
        best = int(fits[best - 1])
    return best


def _two(left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """Two of the lengths left whose sum is as large as room allows and over least."""
    have = np.flatnonzero(left[:room] > 0)
    if not len(have):
        return None
    fits = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
    other = fits[room - have]
    same = (other == have) & (left[have] < 2)
    other[same] = fits[have[same] - 1]
    total = np.where(other > 0, have + other, 0)
    i = int(total.argmax())
    return (int(have[i]), int(other[i])) if total[i] > least else None


def placements(plan: list[tuple[int, list[int]]]) -> pd.DataFrame:
    """For each length the rank intervals of its pieces: (length, first, each, sequence, offsets).

    Piece number `first + b * each + k` of a length is the k-th of that length in sequence `sequence + b`.
    At most one row for each length of each step of the plan.
    """
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for times, bin_ in plan:
        places: dict[int, list[int]] = {}
        offset = 0
        for n in bin_:
            places.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in places.items():
            rows.append((n, ranks.get(n, 0), len(offsets), sequence, offsets))
            ranks[n] = ranks.get(n, 0) + times * len(offsets)
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offsets"])


def _placer(table: pd.DataFrame):
    table = table.sort_values(["length", "first"])
    lengths, first, each, sequence = (table[c].to_numpy(np.int64) for c in ("length", "first", "each", "sequence"))
    offsets = np.concatenate([np.asarray(x, dtype=np.int64) for x in table["offsets"]]) if len(table) else np.zeros(0, np.int64)
    begins = np.cumsum(each) - each
    # ranks stay below 2 ** 50, lengths below 2 ** 12
    order = lengths * (1 << 50) + first

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["rank"].to_numpy(np.int64)
            row = np.searchsorted(order, batch["length"].to_numpy(np.int64) * (1 << 50) + rank, side="right") - 1
            nth = rank - first[row]
            yield batch.drop(columns="rank").assign(
                doc_id=batch["doc_id"].astype("Int64"), sequence_id=sequence[row] + nth // each[row], offset=offsets[begins[row] + nth % each[row]]
            )

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, tkey, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is its end token alone.  Repeated rows are packed each for itself.
    Texts of any length are tokenised whole and cut after.  Pieces of one length are alike to the plan: which of them goes where
    is settled by a running number.
    An empty table gives no rows.  Sequences hold at most `capacity` tokens, without gaps from 0.
    """
    pieces = materialize(tokenized_pieces(docs), "pieces")
    # repeated rows have equal keys, and so a running number tells their pieces apart
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "tkey", "piece", F.monotonically_increasing_id()), F.lit(GROUPS)).cast("int"))
    pieces = materialize(pieces, "grouped-pieces")
    counts = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    within = Window.partitionBy("length", "group").orderBy("doc_id", "tkey", "piece")
    ranked = pieces.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "group"])
    ranked = ranked.select("doc_id", "tkey", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(_placer(placements(plan_bins(histogram, capacity))), schema)
