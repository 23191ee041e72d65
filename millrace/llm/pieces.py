"""SentencePiece encoding and decoding by a table of distinct chunks.

A text's white space becomes markers, one more in front.  Where no piece of the model holds a marker after another
character, no merge crosses such a place, so a text falls into chunks (markers, then a word) that are segmented alone and
whose ids, joined by position, are those of the whole text.  The table of distinct chunks is counted over all texts; those of
its most frequent chunks that fit a stated bound are segmented once, as Spark's own job, and broadcast.  A rarer chunk
is segmented once by each task that meets it: to send its ids back by position, every text and each of its rare words would
have to be shuffled.

A model whose pieces cross markers, or that normalises texts otherwise, gets whole texts as chunks, which is exact too.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, discard, fresh, frame, materialize

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Chunks that are broadcast at most, and characters of each: under 60 MB in a Python worker.
FREQUENT, LONGEST = 1 << 18, 48
#: Distinct chunks that a task counts before it passes them on, and rarer ones whose ids it keeps.
HELD = 300_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Spaces, markers, letters that compatibility forms change, and a control character.
_PROBE = f"  a ﬁ　Å{MARK}\t b\x07 "


class Segmenter:
    """Chunks of texts, and ids and decoded text of chunks.  A chunk is named without its first marker."""

    def __init__(self, model: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        plain = self.library.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
        self.cuts = plain and not crossing and MARK in pieces
        # decoding strips the marker of what stands first, so a piece without one stands before a chunk
        self.guard = next((i for i, p in enumerate(pieces) if len(p) == 1 and p != MARK and p.isalpha()), None)
        self.cuts = self.cuts and self.guard is not None
        self.alone = self.library.piece_to_id(MARK)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def segment(self, chunks: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of each chunk."""
        ids = [i if c else [self.alone] for i, c in zip(self.library.encode(chunks, num_threads=1), chunks, strict=True)]
        if self.cuts:
            texts = [t[1:] for t in self.library.decode([[self.guard, *i] for i in ids], num_threads=1)]
        else:
            texts = self.library.decode(ids, num_threads=1)
        return [(",".join(map(str, i)), t) for i, t in zip(ids, texts, strict=True)]

    def whole(self, parts: list[tuple[str, str]]) -> tuple[str, str]:
        """Ids and decoded text of a text, from those of its chunks by position."""
        text = "".join([p[1] for p in parts])
        return ",".join([p[0] for p in parts]), text[1:] if self.cuts and parts else text


def chunk_table(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(chunk, n): the distinct chunks of all texts and how often each occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = Segmenter(model), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                held.update(own.chunks(text))
                if len(held) >= HELD:
                    yield frame(list(held.items()), ["chunk", "n"])
                    held.clear()
        yield frame(list(held.items()), ["chunk", "n"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent_chunks(table: DataFrame, most: int = FREQUENT, model: str = MODEL) -> dict[str, tuple[str, str]]:
    """The segmented chunks of the largest counts, `most` at most, with all chunks of a count or none."""
    short = table.where(F.char_length("chunk") <= LONGEST)
    # counts by powers of 2 in sixteenths: some hundred rows whatever the table
    steps = short.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("chunks")).collect()
    least, taken = None, 0
    for step, chunks in sorted(steps, reverse=True):
        taken += chunks
        if taken > most:
            break
        least = step
    if least is None:
        return {}

    @F.pandas_udf("ids string, decoded string")
    def segmented(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Segmenter(model)
        for part in parts:
            yield frame(own.segment(part.tolist()), ["ids", "decoded"])

    chosen = short.where(F.floor(F.log2("n") * 16) >= least).select("chunk", segmented("chunk").alias("s"))
    rows = chosen.select("chunk", "s.*").toPandas()
    return dict(zip(rows["chunk"], zip(rows["ids"], rows["decoded"], strict=True), strict=True))


def encode(docs: DataFrame, model: str = MODEL, most: int = FREQUENT, digests: bool = False) -> DataFrame:
    """Rows of docs with `ids` (array), and `decoded`, the text that these ids give; with digests, counts and hashes instead.

    digests: n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of UTF-8); text and the other columns of
    documents but doc_id are then left out.  Columns of docs by the new names stay; the new ones get a leading underscore.
    Null and empty texts have no ids and decode to nothing.  Texts of any length are read whole.  Each row is
    encoded for itself: repeated rows, ties and null ids too.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    counted = materialize(chunk_table(docs, model), "chunks")
    known = spark.sparkContext.broadcast(frequent_chunks(counted, most, model))
    discard(counted)

    def assembled(texts: Iterator[pd.Series]) -> Iterator[list[tuple[str, str]]]:
        own, frequent, rare = Segmenter(model), known.value, {}
        for part in texts:
            out = []
            for text in part:
                chunks = own.chunks(text)
                unknown = [c for c in dict.fromkeys(chunks) if c not in frequent and c not in rare]
                if len(rare) + len(unknown) > HELD:
                    rare = {c: rare[c] for c in set(chunks) & rare.keys()}
                rare.update(zip(unknown, own.segment(unknown), strict=True))
                out.append(own.whole([frequent.get(c) or rare[c] for c in chunks]))
                for long in (c for c in unknown if len(c) > LONGEST):
                    del rare[long]
            yield out

    text = F.coalesce(F.col("text"), F.lit(""))
    if digests:

        @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            for rows in assembled(texts):
                yield frame([(i.count(",") + bool(i), sha(i), sha(t)) for i, t in rows], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return docs.select("doc_id", run(text).alias("s")).select("doc_id", "s.*")

    @F.pandas_udf("ids array<int>, decoded string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in assembled(texts):
            yield frame([(np.array(i.split(",") if i else [], dtype=np.int32), t) for i, t in rows], ["ids", "decoded"])

    s, ids = fresh(docs, "s"), fresh(docs, "ids")
    out = docs.withColumn(s, run(text))
    return out.withColumns({ids: F.col(f"{s}.ids"), fresh(docs, "decoded"): F.col(f"{s}.decoded")}).drop(s)
