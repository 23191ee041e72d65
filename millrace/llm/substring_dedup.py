"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after their marks and at line ends.  Sentences of LONG_WORDS words or more are cut
further into pieces at borders that their own words define, the word of the least hash among every WINDOW words, so
that passages align that begin or end within a sentence, or that have no marks at all.  Characters of scripts without
spaces are words.  Sentences and pieces are units.  A span is a run of consecutive units: the shortest of SPAN_WORDS
words or more that begins at a unit, and the shortest that ends at one.

Spans are hashed (96 bits) and joined over the corpus, and the units of every span that is not its first occurrence are
removed: the first is in the row that comes first by (doc_id, hash of the text), rows without an id last, and within
a row by position.  SPAN_WORDS is the least length of a repetition: shorter ones, license lines for example, stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, frame, keyed, materialize

SPAN_WORDS = 28
#: Words of a sentence that is cut into pieces, and the words of which one begins a piece.
LONG_WORDS, WINDOW = 20, 10
#: Repeated hashes that are broadcast to find their spans; more of them are joined by a shuffle.
FEW = 1_500_000

#: A sentence ends after its marks or at a line end.
_BORDER = re.compile(r"[.!?]+\s+|[。！？]+\s*|\n+")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
#: Two odd multipliers and their inverses modulo 2 ** 64: a span's hash is a polynomial of its words' hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: list[np.ndarray] = []
_known: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    """Words between white space, in lower case; a character of a script without spaces is one."""
    text = text.lower()
    return _WORD.findall(text) if _ANY_UNSPACED.search(text) else text.split()


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of the sentences, each with the white space after it; they cover the text."""
    ends = [m.end() for m in _BORDER.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def _hash_words(words: list[str]) -> np.ndarray:
    if len(_known) > 500_000:
        _known.clear()
    try:
        return np.array([_known[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in _known:
                _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.array([_known[w] for w in words], dtype=np.uint64)


def _power(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 of the bases and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, n)
        _powers[:] = [np.cumprod(np.array([1] + [b] * (size - 1), dtype=np.uint64)) for b in (*_BASES, *_INVERSES)]
    return _powers


class Cut:
    """A text's sentences (spans of code points, numbers of words) and units (borders in words)."""

    def __init__(self, text: str):
        self.text, self.sentences, words, self.sizes = text, sentences(text), [], []
        cut = str.split if text.isascii() else words_of  # ASCII has no script without spaces, and lower case has its length
        lower = text.lower() if text.isascii() else text
        for a, b in self.sentences:
            found = cut(lower[a:b])
            words += found
            self.sizes.append(len(found))
        self.hashes = _hash_words(words)
        self.starts = np.cumsum([0, *self.sizes])
        self.borders = np.unique(np.concatenate([self.starts, self._pieces()]))

    def _pieces(self) -> np.ndarray:
        sizes = np.asarray(self.sizes, dtype=np.int64)
        n = len(self.hashes)
        if n < WINDOW or not (sizes >= LONG_WORDS).any():
            return np.zeros(0, dtype=np.int64)
        number = np.repeat(np.arange(len(sizes)), sizes)
        windows = np.lib.stride_tricks.sliding_window_view(self.hashes, WINDOW)
        # of equal hashes the last, whatever stands before the window
        least = np.arange(n - WINDOW + 1) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
        inside = (number[: n - WINDOW + 1] == number[WINDOW - 1 :]) & (sizes[number[: n - WINDOW + 1]] >= LONG_WORDS)
        return np.unique(least[inside])

    def spans(self, hashes: int = 2) -> tuple[np.ndarray, ...]:
        """(first unit, end unit) of all spans, in order, and so many 64-bit hashes of each, two at most."""
        b = self.borders
        units = np.arange(len(b))
        ends = np.searchsorted(b, b + SPAN_WORDS)
        firsts = np.searchsorted(b, b - SPAN_WORDS, side="right") - 1
        pairs = np.concatenate([np.stack([units, ends])[:, ends < len(b)], np.stack([firsts, units])[:, firsts >= 0]], axis=1)
        pairs = np.unique(pairs[0] * len(b) + pairs[1])
        i, j = pairs // len(b), pairs % len(b)
        n = len(self.hashes)
        power = _power(n + 1)
        out = []
        for k in range(hashes):
            h = (self.hashes ^ (self.hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) if k else self.hashes
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power[k][:n])])
            span = (sums[b[j]] - sums[b[i]]) * power[k + 2][b[i]] + (b[j] - b[i]).astype(np.uint64)
            out.append(((span ^ (span >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64))
        return np.stack([i, j]), *out

    def remove(self, repeated: np.ndarray) -> tuple[int, str, str]:
        """Sentences that lose words, the removed spans start:end in code points, and the text that stays.

        A span of units goes if its first hash is among repeated, or if the text has had it before.
        """
        (i, j), h = self.spans(1)
        again = np.ones(len(h), dtype=bool)
        again[np.unique(h, return_index=True)[1]] = False
        again |= np.isin(h, repeated)
        change = np.zeros(len(self.borders) + 1, dtype=np.int64)
        np.add.at(change, i[again], 1)
        np.add.at(change, j[again], -1)
        gone = np.flatnonzero(np.cumsum(change)[: len(self.borders) - 1] > 0)
        if not len(gone):
            return 0, "", self.text
        at: dict[int, int] = {}  # code points of the borders of units that go
        touched = set()
        words_at: dict[int, list[int]] = {}  # code points of a sentence's words, found once
        for k in sorted({int(x) for u in gone.tolist() for x in (self.borders[u], self.borders[u + 1])}):
            s = int(np.searchsorted(self.starts, k, side="left"))
            if s < len(self.starts) and self.starts[s] == k:
                at[k] = self.sentences[s][0] if s < len(self.sentences) else len(self.text)
            else:
                a, b = self.sentences[s - 1]
                if s not in words_at:
                    words_at[s] = [a + m.start() for m in _WORD.finditer(self.text[a:b])]
                at[k] = words_at[s][k - int(self.starts[s - 1])]
        spans: list[list[int]] = []
        for u in gone.tolist():
            a, b = at[int(self.borders[u])], at[int(self.borders[u + 1])]
            touched.add(int(np.searchsorted(self.starts, self.borders[u], side="right")))
            if spans and spans[-1][1] == a:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        kept, last = [], 0
        for a, b in spans:
            kept.append(self.text[last:a])
            last = b
        return len(touched), ",".join(f"{a}:{b}" for a, b in spans), "".join([*kept, self.text[last:]])


_SPANS = T.StructType([T.StructField("own", T.BooleanType()), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("g", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_SPANS)
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Whether a span repeats within the text, and the distinct spans' hashes."""
    for batch in texts:
        rows = []
        for text in batch:
            _, h, g = Cut(text).spans()
            first = np.unique(h, return_index=True)[1]
            rows.append((len(first) < len(h), h[first], (g[first] >> 32).astype(np.int32)))
        yield frame(rows, _SPANS.names)


_CUT = T.StructType(
    [T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType())]
    + [T.StructField("removed", T.StringType()), T.StructField("kept_text", T.StringType())]
)


@F.pandas_udf(_CUT)
def _remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """repeated: null where nothing of the text repeats."""
    for texts, repeated in batches:
        rows = []
        for text, r in zip(texts, repeated, strict=True):
            cut = None if r is None else Cut(text)
            n = sum(not text[a:b].isspace() for a, b in (cut.sentences if cut else sentences(text)))
            rows.append((n, *(cut.remove(np.asarray(r, dtype=np.int64)) if cut else (0, "", text))))
        yield frame(rows, _CUT.names)


@F.pandas_udf(_CUT)
def _remove_all(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of texts that an earlier row has whole: every span goes."""
    for batch in texts:
        rows = []
        for text in batch:
            cut = Cut(text)
            rows.append((sum(map(bool, cut.sizes)), *cut.remove(cut.spans()[1])))
        yield frame(rows, _CUT.names)


def _repeated(spans: DataFrame) -> DataFrame:
    """(tkey, repeated) of the texts with spans that repeat within them or that an earlier text has.

    Hashes that occur once, nearly all, are dropped by a count of the first 64 bits before texts come into it.
    """
    many = materialize(spans.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    found = spans.select("doc_id", "tkey", F.explode(F.arrays_zip("h", "g")).alias("s")).select("doc_id", "tkey", "s.h", "s.g")
    found = materialize(found.join(F.broadcast(many) if many.count() <= FEW else many, "h"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tkey").alias("tkey"))
    firsts = found.groupBy("h", "g").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select("h", "g", "first")
    later = found.join(firsts, ["h", "g"]).where(order > F.col("first")).select("tkey", "h")
    own = spans.where("own").select("tkey", F.lit(None).cast("long").alias("h"))
    out = materialize(later.unionAll(own).groupBy("tkey").agg(F.collect_set("h").alias("repeated")), "later")
    discard(many)
    discard(found)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_removed, removed (start:end, code points), kept_text of every row.

    n_removed counts the sentences that lose words.  Rows that share an id, or have none, are documents of their own; of
    rows equal in id and text one is the first, and the others lose every span.  A null or empty text has no sentences.
    Texts of any length are read whole.  No row is dropped, even if all its sentences are.
    """
    rows = keyed(docs)
    # of each text the first row holds its spans, and rows after it lose them all
    groups = rows.groupBy("doc_id", "tkey").agg(F.count("*").alias("n")).groupBy("tkey")
    groups = groups.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("n").alias("n"))).alias("first"), F.sum("n").alias("rows"))
    copies = materialize(groups.where("rows > 1").select("tkey", "first"), "copies")
    few = copies.count() <= FEW
    marked = rows.join(F.broadcast(copies) if few else copies, "tkey", "left")
    leads = F.col("first").isNull() | F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    spans = materialize(marked.where(leads).select("doc_id", "tkey", _spans("text").alias("s")).select("doc_id", "tkey", "s.*"), "spans")
    later = _repeated(spans)
    discard(spans)
    alone = F.coalesce(F.col("first.n"), F.lit(1)) == 1
    first, rest = [marked.where(leads & alone)], [marked.where(~leads).select("doc_id", "text")]
    if not copies.where("first.n > 1").isEmpty():
        equal = marked.where(leads & ~alone).groupBy("doc_id", "tkey").agg(F.first("text").alias("text"), F.first("first").alias("first"))
        first.append(equal.select(*marked.columns))
        rest.append(equal.select("doc_id", "text", F.explode(F.expr("sequence(2L, first.n)"))).drop("col"))
    cut = [r.select("doc_id", _remove_all("text").alias("cut")) for r in rest]
    cut += [f.join(later, "tkey", "left").select("doc_id", _remove("text", "repeated").alias("cut")) for f in first]
    return reduce(DataFrame.unionAll, cut).select("doc_id", "cut.n_sentences", "cut.n_removed", "cut.removed", "cut.kept_text")
