"""LM scoring by a hierarchical Pitman-Yor model.

A word's context is the word before it (a document's end, for its first).  Every pair of words has its place:

- The CONTEXTS most frequent words have restaurants over the DISHES most frequent words and one dish more, all rarer
  words together.  Of this dish the classes of rare words (CLASSES) are told apart by their counts after the word, and
  within a class the words by a restaurant of the pair of word and class.
- Every other word has a restaurant over all words, frequent or rare.

Parents of the contexts' restaurants are those of word endings, and the endings share a root, over the same dishes; among
rare words the restaurant of words tells apart.  That one has as its base a spelling model: restaurants for the contexts of
the two bytes before, which share the restaurant of the one byte before as their parent, and these share the root.

Each table of a restaurant is a customer of its parent.  Customers are seated by the Chinese-restaurant rule and
all of them reseated again and again by Gibbs sampling, dish by dish, from sweep to sweep; predictive probabilities
are averages over the samples of the second half of the last sweep.  (For a fixed parent they are linear in the number of tables, so that
the average table counts give them, and in every context they sum to one over all words, known or not.)

Spark counts words, pairs and spellings, seats the words of the corpus, task by task, and the restaurants of
contexts and spellings, one group for each ending or last byte, whose subtree of contexts it holds whole.
The spelling model has at most 256 ** 3 entries and these contexts at most (CONTEXTS + ENDINGS) * (DISHES + 1),
however large the corpus.  The words and all other pairs grow with it: their tokens are dealt by restaurant to buckets of
about PAIRS tokens, where the pairs are counted, seated and scored, and only sums for documents go on.  (The endings' restaurants and
that of words seat tokens, not the tables of these pairs.)  Words are known there by keys of 64 bits.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frame, keyed, materialize

#: Words, the most frequent ones, whose probabilities every task has at hand; the others are joined.
AT_HAND = 150_000
#: Words, the most frequent ones, that have context restaurants of their own, and that are dishes of these restaurants.
CONTEXTS, DISHES = 500, 10_000
#: Contexts that rarer words share, and parents of the others: classes of the last two bytes.
ENDINGS = 64
#: Reseatings of all customers of each dish in a sweep, the first half of which are burn-in, and sweeps.
RESEATS = 8
SWEEPS = 3
#: Customers of a dish whose number of tables is drawn from a table of its law.
EXACT = 64
#: Customers beyond which many are seated at once in a proposal.
LEAP = 256
#: Sweeps over the words, each a pass of Spark, and about how many words are seated together.
WORD_SWEEPS, TOGETHER = 2, 20_000
#: Parts in which the driver fetches the probabilities of contexts.
PARTS = 8
#: Tokens, about how many, whose pairs are seated together; reseatings of these; classes of the rare words after a frequent one.
PAIRS, PAIR_RESEATS, CLASSES = 1_000_000, 4, 64
STRENGTH = 1.0
SEED = 4
#: The end of a document as a word, and of a word as a byte: neither occurs within words.
END, STOP = b"", 0x20
_CHUNK = 20_000


# --- restaurants -----------------------------------------------------------------------------------------


class Seating(NamedTuple):
    #: tables of each dish: the last sample, and the mean of the second half
    tables: np.ndarray
    mean: np.ndarray


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series seven steps on."""
    low = np.ones_like(x)
    for k in range(7):
        low = low * (x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def _seat_anew(customers: np.ndarray, x: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of so many customers of a restaurant without dishes, of strength x - discount.

    Table by table: of those not seated yet the first one's table leaves a Beta share, of whom a Binomial number sits elsewhere.
    """
    tables = np.ones(len(customers))
    some = np.flatnonzero(customers <= LEAP)
    rows, left, strength = some, customers[some].astype(np.int64) - 1, x[some]
    while len(rows):
        left = rng.binomial(left, rng.beta(np.maximum(strength, 1e-12), 1 - discount))
        on = left > 0
        rows, left, strength = rows[on], left[on] - 1, strength[on] + discount
        tables[rows] += 1
    # of more customers a sixteenth of those seated come at once: the chance of a new table is that of their middle
    rows = np.flatnonzero(customers > LEAP)
    seated = 1
    while len(rows):
        come = np.minimum(max(1, seated // 16), customers[rows] - seated).astype(np.int64)
        theta, held = x[rows] - discount, tables[rows]
        first = np.minimum(1.0, (theta + discount * held) / (theta + seated))
        middle = (theta + discount * (held + first * (come - 1) / 2)) / (theta + seated + (come - 1) / 2)
        tables[rows] += rng.binomial(come, np.clip(middle, 0.0, 1.0))
        seated += max(1, seated // 16)
        rows = rows[customers[rows] > seated]
    return tables


@cache
def _ways(discount: float) -> np.ndarray:
    """log of the number of ways (weighted by the discount) to seat c customers at t tables, row c and column t, c <= EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        stay = np.arange(EXACT + 1)
        stay = np.where(c > discount * stay, np.log(np.maximum(c - discount * stay, 1e-300)), -np.inf)
        out[c + 1] = np.logaddexp(out[c] + stay, np.concatenate([[-np.inf], out[c][:-1]]))
    return out


def _seat_few(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of at most EXACT customers, drawn from their law itself."""
    ways, out = _ways(discount), np.ones(len(customers))
    width = np.ceil(np.log2(np.maximum(customers, 2))).astype(int)
    for k in range(1, int(width.max(initial=0)) + 1):
        rows = np.flatnonzero(width == k)
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            t = np.arange(1, min(EXACT, 1 << k) + 1)
            law = ways[customers[part].astype(int)][:, t] + np.log(weight[part])[:, None] * t
            law = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (law < (rng.random(len(part)) * law[:, -1])[:, None]).sum(axis=1)
    return out


def _seat_around(customers: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """log of the weight of a seating with so many tables: all but the largest by their own law, Sibuya's, the largest taking the rest.

    -inf if the rest is not the largest.
    """
    k = tables.astype(np.int64) - 1
    row = np.repeat(np.arange(len(k)), k)
    size = np.minimum(rng.geometric(np.maximum(rng.beta(discount, 1 - discount, len(row)), 1e-15)), 1e15)
    rest = customers - np.bincount(row, size, len(k))
    most = np.zeros(len(k))
    np.maximum.at(most, row, size)
    ties = 1 + np.bincount(row, size == rest[row], len(k))
    fits = (rest >= 1) & (rest >= most)
    held = np.where(fits, rest, 1.0)
    return np.where(fits, _log_gamma(held - discount) - _log_gamma(held + 1) - np.log(ties), -np.inf)


def gibbs(
    customers: np.ndarray, base: np.ndarray, where: np.ndarray, discount: float, rng: np.random.Generator,
    others: np.ndarray | None = None, tables: np.ndarray | None = None, reseats: int = RESEATS,
) -> Seating:
    """Sample the numbers of tables of dishes with so many customers each, all of whom are reseated every time.

    where[i] is the restaurant of dish i and base[i] the parent's probability of it; others: tables of the restaurants
    that dishes not given here have; tables: the state to go on from.  A Gamma variable for each restaurant, given its
    number of tables, makes its dishes independent of one another: a dish then has t tables with a weight of w ** t times
    the number of ways to seat its customers at t tables.  Up to EXACT customers are seated by this law itself.  More are
    all seated anew, and the seating is taken with Metropolis and Hastings' probability.  It is proposed in one of two
    ways: few tables for the customers, as a Poisson number of tables around the largest; many, by the
    Chinese-restaurant rule at a strength that gives w on average.
    """
    start = (customers > 0) * 1.0 if tables is None else np.array(tables, dtype=float)
    mean = np.ones(len(customers))
    many = np.flatnonzero(customers > 1)
    if not len(many):
        return Seating(start, mean)
    rooms = int(where.max()) + 1
    others = np.zeros(rooms) if others is None else others
    c, room = np.round(customers[many]), where[many]
    total, counted = np.zeros(len(many)), 0
    now = start
    held = others + np.bincount(where, now, rooms)
    few = (STRENGTH + discount * held)[room] * base[many] < discount * c**discount
    small, loose, tight = np.flatnonzero(c <= EXACT), np.flatnonzero(few & (c > EXACT)), np.flatnonzero(~few & (c > EXACT))
    logs = None
    for step in range(reseats):
        held = others + np.bincount(where, now, rooms)
        weight = np.maximum(discount * rng.gamma(STRENGTH / discount + held)[room] * base[many], 1e-300)
        found, before = now[many], now[many]
        found[small] = _seat_few(c[small], weight[small], discount, rng)
        # few tables: only proposals are weighed, and the first is taken as it is
        tables_, w = 1.0 + rng.poisson(weight[loose] / discount), c[loose]
        new = _seat_around(w, tables_, discount, rng)
        takes = np.log(rng.random(len(loose))) < new - logs if logs is not None else new > -np.inf
        logs = np.where(takes, new, _seat_around(w, np.ones(len(w)), discount, rng) if logs is None else logs)
        found[loose] = np.where(takes, tables_, before[loose] if step else 1.0)
        # many tables
        w = x = weight[tight]
        for _ in range(6):
            x = w * ((x + (1 - discount) / 2) / (x + c[tight] - (1 + discount) / 2)) ** discount
        x = np.maximum(x, 1e-300)
        anew, old = _seat_anew(c[tight], x, discount, rng), before[tight]
        if step or tables is not None:
            odd = np.flatnonzero(anew != old)
            y, ratio = x[odd] / discount + 1e-300, np.log(w[odd] / discount)
            gain = (anew[odd] - old[odd]) * ratio - _log_gamma(y + anew[odd] - 1) + _log_gamma(y + old[odd] - 1)
            stays = odd[np.log(rng.random(len(odd))) >= gain]
            anew[stays] = old[stays]
        found[tight] = anew
        now = now.copy()
        now[many] = found
        if step >= reseats // 2:
            total += found
            counted += 1
    mean[many] = total / counted
    return Seating(now, mean)


def gibbs_in_blocks(customers: np.ndarray, base: np.ndarray, where: np.ndarray, discount: float, rng: np.random.Generator, tables: np.ndarray | None = None) -> Seating:
    """gibbs() of any number of dishes in bounded memory: a block at a time, the others as they were last seated."""
    begun = tables is not None
    tables = np.array(tables, dtype=float) if begun else np.ones(len(customers))
    mean = np.ones(len(customers))
    rooms = int(where.max()) + 1 if len(where) else 0
    held = np.bincount(where, tables, rooms)
    for at in range(0, len(customers), _CHUNK):
        part = slice(at, at + _CHUNK)
        others = held - np.bincount(where[part], tables[part], rooms)
        seated = gibbs(customers[part], base[part], where[part], discount, rng, others[: int(where[part].max()) + 1], tables[part] if begun else None)
        tables[part], mean[part] = seated
        held = others + np.bincount(where[part], tables[part], rooms)
    return Seating(tables, mean)


def predictive(customers, tables, room_customers, room_tables, discount: float, base):
    """Probability of a dish given its parent's."""
    return (customers - discount * tables) / (STRENGTH + room_customers) + (STRENGTH + discount * room_tables) / (STRENGTH + room_customers) * base


def discount_of(singles: float, pairs: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return min(0.95, max(0.05, singles / (singles + 2 * pairs))) if singles else 0.5


# --- spelling --------------------------------------------------------------------------------------------


class Spelling:
    """P(byte | two bytes before) of words, each ended by STOP and begun after two of them."""

    def __init__(self, codes: np.ndarray, probabilities: np.ndarray, backoff: np.ndarray, parent: np.ndarray):
        #: seen (byte, byte, byte) codes and their probabilities; backoff of each context; P(byte | byte before)
        self.parts = codes, probabilities, backoff, parent
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self.table = parts, None

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word's bytes and end."""
        if self.table is None:
            codes, probabilities, backoff, parent = self.parts
            full = backoff.astype(np.float32).reshape(256, 256, 1) * parent.astype(np.float32).reshape(1, 256, 256)
            full.reshape(-1)[codes] = probabilities
            self.table = np.log10(full, out=full).reshape(-1)
        if not words:
            return np.zeros(0)
        codes, lengths = spell(words)
        return np.add.reduceat(self.table[codes].astype(np.float64), np.cumsum(lengths) - lengths)

    def log10_of_few(self, words: list[bytes]) -> np.ndarray:
        """The same without a table of all codes, which takes 67 MB of a task."""
        if not words:
            return np.zeros(0)
        codes, lengths = spell(words)
        seen, probabilities, backoff, parent = self.parts
        p = backoff.astype(np.float32)[codes >> 8] * parent.astype(np.float32).reshape(-1)[codes & 0xFFFF]
        if len(seen):
            at = np.minimum(np.searchsorted(seen, codes), len(seen) - 1)
            p = np.where(seen[at] == codes, probabilities.astype(np.float32)[at], p)
        return np.add.reduceat(np.log10(p).astype(np.float64), np.cumsum(lengths) - lengths)


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (two bytes before, byte) of all words' bytes and ends in turn, and how many of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stream = np.frombuffer(b"  " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int32)
    before = stream[1:-1].copy()
    before_that = stream[:-2].copy()
    first = np.cumsum(lengths) - lengths
    before_that[first] = STOP
    # a word of one byte or none: the second position's context begins before the word as well
    second = first[lengths > 1] + 1
    before_that[second] = STOP
    return before_that << 16 | before << 8 | stream[2:], lengths


def _count_spellings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [bytes(w) for w in batch["word"]]
        codes, lengths = spell(words)
        weight = np.repeat(batch["t"].to_numpy(np.float64), lengths)
        order = np.argsort(codes, kind="stable")
        codes, weight = codes[order], weight[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        yield pd.DataFrame({"code": codes[first], "n": np.add.reduceat(weight, first).astype(np.int64)})


def _seat_spellings(root: np.ndarray, discount: float):
    def seat(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """One group: all contexts that end in a byte, the restaurant of that byte alone above them."""
        rng = np.random.default_rng([SEED, int(key[0])])
        group = group.sort_values("code")
        code, n = group["code"].to_numpy(np.int64), group["n"].to_numpy(np.float64)
        context, symbol = code >> 16, code & 255
        parent = root[symbol]
        symbols, back = np.unique(symbol, return_inverse=True)
        low = high = None
        for _ in range(SWEEPS):
            low = gibbs(n, parent, context, discount, rng, tables=low and low.tables)
            above = np.bincount(back, low.tables)
            # the state goes on, but that a dish has no more tables than customers
            high = gibbs(above, root[symbols], np.zeros(len(symbols), np.int64), discount, rng, tables=high and np.minimum(high.tables, above))
            sure = predictive(above, high.mean, above.sum(), high.mean.sum(), discount, root[symbols])
            parent = sure[back]
        above = np.bincount(back, low.mean)
        return pd.concat(
            [
                pd.DataFrame({"code": code, "depth": 2, "n": n, "t": low.mean}),
                pd.DataFrame({"code": symbols | int(key[0]) << 8, "depth": 1, "n": above, "t": np.minimum(high.mean, above)}),
            ]
        )

    return seat


def fit_spelling(words: DataFrame) -> Spelling:
    """The spelling model of the tables t of words (word, t): at most 256 ** 3 counts come out of the corpus."""
    counts = words.mapInPandas(_count_spellings, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "spellings")
    stats = counts.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    discount = discount_of(stats["one"], stats["two"])
    # the root begins with the number of bytes that each byte follows
    pairs = counts.select((F.col("code") % 65536).alias("pair")).distinct().groupBy((F.col("pair") % 256).alias("symbol")).count().collect()
    root = np.zeros(256)
    for row in pairs:
        root[row["symbol"]] = row["count"]
    base = predictive(root, (root > 0) * 1.0, root.sum(), (root > 0).sum(), discount, 1 / 256)
    seated = counts.withColumn("last", F.expr("(code div 256) % 256").cast("int")).groupBy("last").applyInPandas(
        _seat_spellings(base, discount), "code int, depth tinyint, n float, t float"
    )
    kinds = {"depth": "i1", "code": "i4", "n": "f4", "t": "f4"}
    rows = pd.DataFrame(dict(zip(kinds, gathered(seated, **kinds), strict=True))).sort_values(["depth", "code"])
    one, two = rows[rows["depth"] == 1], rows[rows["depth"] == 2]
    # the root again, with the tables of its children
    root = np.bincount(one["code"].to_numpy() & 255, one["t"].to_numpy(), 256)
    top = gibbs(np.round(root), np.full(256, 1 / 256), np.zeros(256, np.int64), discount, np.random.default_rng(SEED))
    top = np.where(root > 0, top.mean, 0.0)
    base = predictive(root, top, root.sum(), top.sum(), discount, 1 / 256)

    def grid(part: pd.DataFrame, rooms: int, column: str) -> np.ndarray:
        return np.bincount(part["code"].to_numpy() >> 8, part[column].to_numpy(), rooms)

    backoff = (STRENGTH + discount * grid(one, 256, "t")) / (STRENGTH + grid(one, 256, "n"))
    parent = backoff[:, None] * base[None, :]
    code = one["code"].to_numpy()
    parent.reshape(-1)[code] += (one["n"].to_numpy() - discount * one["t"].to_numpy()) / (STRENGTH + grid(one, 256, "n")[code >> 8])
    size, tables = grid(two, 65536, "n"), grid(two, 65536, "t")
    code = two["code"].to_numpy()
    backoff = (STRENGTH + discount * tables) / (STRENGTH + size)
    sure = (two["n"].to_numpy() - discount * two["t"].to_numpy()) / (STRENGTH + size[code >> 8]) + backoff[code >> 8] * parent.reshape(-1)[code & 0xFFFF]
    return Spelling(code, sure, backoff, parent)


# --- words -----------------------------------------------------------------------------------------------


def tokens_of(text: str) -> list[bytes]:
    """Words between white space, A-Z lower-cased, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split()


FACTOR = 0x9E3779B97F4A7C15
#: The end of a document in a stream of bytes: no text has this byte.
_MARK = b"\xff"
_PIECE, _BLOCK = 1 << 18, 8 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(key: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return key ^ (key >> np.uint64(31))


_DIGITS = np.where(_SPACE, np.uint64(0), mixed((np.arange(256).astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR modulo 2 ** 64, and their inverses."""
    power, inverse = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    return np.cumprod(power, out=power), np.cumprod(inverse, out=inverse)


class Stream(NamedTuple):
    """Words of a stream of bytes: 64-bit keys (of polynomials over the bytes), last two bytes, ends of documents, and where they lie."""

    key: np.ndarray
    last: np.ndarray
    end: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray

    def spelled(self, spelling: Spelling, which: np.ndarray) -> np.ndarray:
        return spelling.log10_of_few([self.data[a:b].tobytes() for a, b in zip(self.start[which].tolist(), self.stop[which].tolist(), strict=True)])


def _stream(data: bytes, least: int = 0) -> Stream:
    """data: words, the first at the very beginning, each with white space behind; least: bytes that powers are made for."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, stop = np.concatenate([[0], edge[1::2]]), edge[::2]
    power, inverse = _powers(max(least, 1 << len(raw).bit_length()))
    key = mixed(np.add.reduceat(_DIGITS[raw] * power[: len(raw)], start) * inverse[start])
    end = raw[start] == _MARK[0]
    last = np.where(end, STOP, raw[stop - 1]).astype(np.int32)
    return Stream(key, np.where(stop - start > 1, raw[stop - 2], STOP).astype(np.int32) << 8 | last, end, start, stop, raw)


def stream_of(texts: list[bytes]) -> Stream:
    """Words of lower-cased texts, an end before the first and after each."""
    return _stream(b"\xff " + b" \xff ".join(texts) + b" \xff ", _PIECE * 2)


def keys_of(words: list[bytes]) -> np.ndarray:
    return _stream(b" ".join([w or _MARK for w in words]) + b" ").key if words else np.zeros(0, np.uint64)


def gathered(df: DataFrame, **types: str) -> tuple[np.ndarray, ...]:
    """Columns of a bounded table as arrays on the driver; word: by its key.

    Tasks pack them, so that the driver has as many bytes as numbers need, in a row of each task, and no objects of rows.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[list[bytes]] = [[] for _ in types]
        for batch in batches:
            for part, (c, t) in zip(parts, types.items(), strict=True):
                values = keys_of([bytes(w) for w in batch[c]]) if c == "word" else batch[c].to_numpy()
                part.append(values.astype(t).tobytes())
        if parts[0]:
            yield frame([tuple(map(b"".join, parts))], list(types))

    rows = df.select(*types).mapInPandas(pack, ", ".join(f"{c} binary" for c in types)).collect()
    return tuple(np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in types.items())


def class_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(58)).astype(np.int64) % CLASSES


def pieces_of(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in pieces of about _PIECE bytes, and the number of the first."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > _PIECE or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()

    def rows() -> pd.DataFrame:
        return frame(list(counts.items()), ["word", "n"])

    for batch in batches:
        for text in batch["text"]:
            counts.update(tokens_of(text))
            counts[END] += 1
            if len(counts) > 300_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


class WordModel(NamedTuple):
    total: int
    distinct: int
    discount: float
    tables: float
    spelling: Spelling

    @property
    def backoff(self) -> float:
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.total)

    def log10(self, words: list[bytes], counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of words; of a word that is not known counts and tables are 0."""
        spelled = 10.0 ** np.maximum(self.spelling.log10(words), -280)
        return np.log10(np.maximum(0.0, counts - self.discount * tables) / (STRENGTH + self.total) + self.backoff * spelled)


def _seat_words(model: WordModel, tables: float, sweep: int):
    def seat(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Words of one class, in their order, so that the seating is the same however they are dealt to tasks."""
        words = [bytes(w) for w in part["word"]]
        order = sorted(range(len(words)), key=words.__getitem__)
        part, words = part.iloc[order], [words[i] for i in order]
        base = 10.0 ** np.maximum(model.spelling.log10(words), -280)
        rng = np.random.default_rng([SEED, 1, sweep, int(key[0])])
        before = part["t"].to_numpy(np.float64)
        seated = gibbs(part["c"].to_numpy(np.float64), base, np.zeros(len(words), np.int64), model.discount, rng, np.array([tables - before.sum()]), before if sweep else None)
        return pd.DataFrame({"word": pd.Series(words, dtype=object), "c": part["c"].to_numpy(), "t": seated.tables, "mean": seated.mean})

    return seat


def _weigh_words(model: WordModel):
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [bytes(w) for w in batch["word"]]
            logs = model.log10(words, batch["c"].to_numpy(np.float64), batch["mean"].to_numpy())
            spelled = 10.0 ** np.maximum(model.spelling.log10(words), -280)
            yield pd.DataFrame({"word": pd.Series(words, dtype=object), "c": batch["c"].to_numpy(), "lp": logs, "spelled": spelled})

    return weigh


def fit(train: DataFrame) -> tuple[WordModel, DataFrame]:
    """The model of all texts of train (column text), and its words (word, c, lp: log10 of the probability, spelled: that of the spelling)."""
    words = train.select("text").mapInPandas(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    words = materialize(words, "words")
    stats = words.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    total, distinct = int(stats["n"] or 0), int(stats["v"])
    discount = discount_of(stats["one"], stats["two"])
    spelling = fit_spelling(words.select("word", F.lit(1.0).alias("t")))
    model = WordModel(total, distinct, discount, float(distinct), spelling)
    # words that occur once have one table; the others are seated in classes of about TOGETHER, as their number says
    one = F.lit(1.0)
    seated = words.select("word", "c", one.alias("t"), one.alias("mean"))
    classes = max(1, math.ceil((distinct - (stats["one"] or 0)) / TOGETHER))
    for sweep in range(WORD_SWEEPS):
        tables = seated.agg(F.sum("t").alias("t")).first()["t"] or 0.0
        alone, many = seated.where("c = 1"), seated.where("c > 1").groupBy(F.pmod(F.xxhash64("word"), F.lit(classes)).alias("class"))
        now = many.applyInPandas(_seat_words(model, tables, sweep), "word binary, c long, t double, mean double")
        now = materialize(alone.unionAll(now), "seated")
        discard(seated)
        seated = now
    mean = seated.agg(F.sum("mean").alias("m")).first()["m"] or 0.0
    model = WordModel(total, distinct, discount, float(mean), fit_spelling(seated.select("word", "t")))
    return model, materialize(seated.mapInPandas(_weigh_words(model), "word binary, c long, lp double, spelled double"), "weighed")


# --- contexts --------------------------------------------------------------------------------------------


def ending(word: bytes) -> int:
    return zlib.crc32((b"  " + word)[-2:]) % ENDINGS


@cache
def _endings() -> np.ndarray:
    """ending() by the last two bytes."""
    return np.array([zlib.crc32(bytes([i >> 8, i & 255])) % ENDINGS for i in range(1 << 16)], dtype=np.int32)


def ranks_of(ranked: list[bytes]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(ranked)}


def pairs_of(words: list[bytes], ranks: dict[bytes, int]) -> np.ndarray:
    """For each word but the first the code of its context and dish, context * (DISHES + 1) + dish.

    A dish is the word's rank or, for rare words, DISHES; a context the rank or the ending of the word before.
    """
    dish = np.fromiter(map(ranks.get, words, repeat(DISHES)), np.int32, len(words))
    stream = np.frombuffer(b"  " + b" ".join(words), dtype=np.uint8)
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = _endings()[stream[last - 1].astype(np.int32) << 8 | stream[last]]
    context = np.where(dish < CONTEXTS, dish, CONTEXTS + ends)
    return context[:-1] * (DISHES + 1) + dish[1:]


def _count_pairs(ranked: list[bytes]):
    """Counts of pairs_of(), word by word: the plain form that _count_codes() is held to."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, size = ranks_of(ranked), (CONTEXTS + ENDINGS) * (DISHES + 1)
        total = np.zeros(size, dtype=np.int64)
        run = [END]
        for batch in batches:
            for text in batch["text"]:
                run += tokens_of(text)
                run.append(END)
                if len(run) > 1_000_000:
                    total += np.bincount(pairs_of(run, ranks), minlength=size)
                    run = [END]
        total += np.bincount(pairs_of(run, ranks), minlength=size)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"code": found.astype(np.int32), "n": total[found]})

    return count


def _count_codes(keys: np.ndarray, dishes: np.ndarray):
    """Counts of _count_pairs() and, behind these, of classes of rare words after each frequent one; keys: of the dishes, sorted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = (CONTEXTS + ENDINGS) * (DISHES + 1)
        total = np.zeros(pairs + CONTEXTS * CLASSES, dtype=np.int64)

        def add(texts: list[bytes]) -> None:
            for _, part in pieces_of(texts):
                words = stream_of(part)
                at = np.minimum(np.searchsorted(keys, words.key), len(keys) - 1)
                dish = np.where(keys[at] == words.key, dishes[at], DISHES)
                context, dish = np.where(dish < CONTEXTS, dish, CONTEXTS + _endings()[words.last])[:-1], dish[1:]
                rare = (context < CONTEXTS) & (dish == DISHES)
                found = np.concatenate([context * (DISHES + 1) + dish, pairs + context[rare] * CLASSES + class_of(words.key[1:][rare])])
                np.add.at(total, found, 1)

        for batch in batches:
            add([t.encode("utf-8", "surrogatepass").lower() for t in batch["text"]])
        found = np.flatnonzero(total)
        yield pd.DataFrame({"code": found.astype(np.int32), "n": total[found]})

    return count


def _seat_contexts(root: np.ndarray, discount: float):
    def seat(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """One group: the restaurant of an ending, with the words of this ending that have one of their own."""
        rng = np.random.default_rng([SEED, 2, int(key[0])])
        group = group.sort_values("code")
        code, n = group["code"].to_numpy(np.int64), group["n"].to_numpy(np.float64)
        dishes, back = np.unique(code % (DISHES + 1), return_inverse=True)
        own = code < CONTEXTS * (DISHES + 1)
        _, room = np.unique(code[own] // (DISHES + 1), return_inverse=True)
        parent = root[dishes]
        low = high = None
        for _ in range(SWEEPS):
            low = gibbs_in_blocks(n[own], parent[back[own]], room, discount, rng, low and low.tables)
            above = np.bincount(back[own], low.tables, len(dishes)) + np.bincount(back[~own], n[~own], len(dishes))
            high = gibbs(above, root[dishes], np.zeros(len(dishes), np.int64), discount, rng, tables=high and np.minimum(high.tables, above))
            parent = predictive(above, high.mean, above.sum(), high.mean.sum(), discount, root[dishes])
        above = np.bincount(back[own], low.mean, len(dishes)) + np.bincount(back[~own], n[~own], len(dishes))
        shared = (CONTEXTS + int(key[0])) * (DISHES + 1) + dishes
        return pd.concat(
            [
                pd.DataFrame({"ending": int(key[0]), "code": code[own], "n": n[own], "t": low.mean}),
                pd.DataFrame({"ending": int(key[0]), "code": shared, "n": above, "t": np.minimum(high.mean, above)}),
            ]
        )

    return seat


def _weigh_contexts(root: np.ndarray, discount: float):
    def weigh(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """log10 of the probabilities of all dishes in each context of an ending, as 32-bit floats."""
        code, n, t = (group[c].to_numpy() for c in ("code", "n", "t"))
        context, dish = code // (DISHES + 1), code % (DISHES + 1)
        rows, parent = [], root
        for c in sorted(set(context.tolist()), reverse=True):  # the ending's own comes first: it is the highest
            at = context == c
            size, tables = n[at].sum(), t[at].sum()
            now = predictive(0.0, 0.0, size, tables, discount, parent)
            now[dish[at]] += (n[at] - discount * t[at]) / (STRENGTH + size)
            rows.append((c, np.log10(np.maximum(now, 1e-300)).astype("<f4").tobytes()))  # 0: ranks that no word has
            parent = now if c >= CONTEXTS else parent
        return pd.DataFrame(rows, columns=["context", "logs"])

    return weigh


class ContextModel(NamedTuple):
    ranked: list[bytes]
    #: log10 of the probability of a dish by its pair code
    logs: np.ndarray
    #: log10 of the probability that a word is none of the ranked ones, by the restaurant of words
    rare: float
    #: rare words of each class after each frequent word
    counts: np.ndarray


def fit_contexts(train: DataFrame, words: DataFrame) -> ContextModel:
    """The restaurants of contexts of all texts of train; words: as fit() gives them.

    The driver gets DISHES words and a row of DISHES + 1 numbers for each context.  Without training rows
    every word is a rare one.
    """
    top = _frequent(words, DISHES).select("word", "c", "lp").toPandas()
    top["word"] = [bytes(w) for w in top["word"]]
    top = top.sort_values(["c", "word"], ascending=[False, True])
    ranked = top["word"].tolist()
    base = np.zeros(DISHES + 1)
    base[: len(ranked)] = 10.0 ** top["lp"].to_numpy(np.float64)
    base[DISHES] = max(1e-12, 1 - base.sum())
    rare = math.log10(base[DISHES])
    keys = np.append(keys_of(ranked), np.uint64(2**64 - 1))
    by_key = np.argsort(keys)
    dishes = np.append(np.arange(len(ranked)), DISHES)[by_key]
    codes = train.select("text").mapInPandas(_count_codes(keys[by_key], dishes), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = materialize(codes, "pairs")
    size = (CONTEXTS + ENDINGS) * (DISHES + 1)
    code, n = gathered(codes.where(F.col("code") >= size), code="i8", n="f8")  # CONTEXTS * CLASSES rows at most
    counts = np.bincount(code - size, n, CONTEXTS * CLASSES)
    pairs = codes.where(F.col("code") < size)
    stats = pairs.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    discount = discount_of(stats["one"], stats["two"])
    # a context of its own goes with its ending
    context = F.expr(f"cast(code div {DISHES + 1} as int)")
    by_rank = F.array(*[F.lit(ending(w)) for w in ranked[:CONTEXTS]] or [F.lit(0)])
    pairs = pairs.withColumn("ending", F.when(context >= CONTEXTS, context - CONTEXTS).otherwise(F.get(by_rank, context)))
    seated = pairs.groupBy("ending").applyInPandas(_seat_contexts(base, discount), "ending int, code int, n double, t double")
    seated = materialize(seated, "seated-contexts")
    # the root: its customers are the tables of the endings, its base the restaurant of words
    tables = seated.where(F.col("code") >= CONTEXTS * (DISHES + 1)).groupBy((F.col("code") % (DISHES + 1)).alias("dish")).agg(F.sum("t").alias("t"))
    above = np.bincount(*gathered(tables, dish="i8", t="f8"), DISHES + 1)
    top_tables = gibbs(np.ceil(above), base, np.zeros(DISHES + 1, np.int64), discount, np.random.default_rng([SEED, 3])).mean
    top_tables = np.where(above > 0, np.minimum(top_tables, above), 0.0)
    root = predictive(above, top_tables, above.sum(), top_tables.sum(), discount, base)
    logs = np.tile(np.log10(np.maximum(root, 1e-300)).astype(np.float32), CONTEXTS + ENDINGS)
    weighed = seated.groupBy("ending").applyInPandas(_weigh_contexts(root, discount), "context int, logs binary")
    for row in weighed.coalesce(PARTS).toLocalIterator():  # a job for each part, whatever the number of shuffle partitions
        at = row["context"] * (DISHES + 1)
        logs[at : at + DISHES + 1] = np.frombuffer(row["logs"], "<f4")
    return ContextModel(ranked, logs, rare, counts.reshape(CONTEXTS, CLASSES))


# --- scores ----------------------------------------------------------------------------------------------


class AtHand(NamedTuple):
    """What tasks know of the most frequent words, in the order of their keys, and of the model."""

    keys: np.ndarray
    #: log10(c + 1) and log10 of the probability by the restaurant of words; the dish
    counted: np.ndarray
    logs: np.ndarray
    dish: np.ndarray
    contexts: ContextModel
    #: log10 of the share of each class in the rare words' probability, and of the unknown words' and the known ones' in it
    shares: np.ndarray
    unknown: float
    known: float
    #: log10 of the probability of each class of known rare words after each frequent word
    classes: np.ndarray
    model: WordModel
    buckets: int

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys stand, -1 for words that are not at hand, and their dishes."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at = np.where(self.keys[at] == key, at, -1)
        return at, np.where(at < 0, DISHES, self.dish[at])

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Buckets of keys, in their order."""
        return ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def parts(self, key: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each bucket of sorted keys and where it lies."""
        edges = np.searchsorted(self.bucket(key), np.arange(self.buckets + 1))
        yield from ((i, slice(edges[i], edges[i + 1])) for i in np.flatnonzero(np.diff(edges)).tolist())


#: Rows on their way: words (key, log10 of the probability), documents of a block, rare tokens, tokens at hand, rare tokens whose
#: words are resolved, sums for documents.  block: of the documents, whatever it is that data holds columns of.
_WORDS, _DOCS, _RARE, _TOKENS, _RESOLVED, _SPELLED, _RARE_SUMS, _SUMS = range(8)
_ROWS = "bucket int, kind int, block long, data binary"
_COLUMNS = {
    _WORDS: "u8 f8", _DOCS: "i8 u1 i8 i8 i8 f8 f8", _RARE: "u8 u8 u2 u2 f4", _RESOLVED: "u8 u8 f4 u4 u4 u2", _SPELLED: "u2 f8",
    _RARE_SUMS: "u2 f8 f8 u2", _SUMS: "u2 f8",
}
#: The bit of a document's number in its block that says that it is held out.
_HELD = 1 << 15


def _pack(kind: int, columns) -> bytes:
    return b"".join(np.asarray(c).astype("<" + t).tobytes() for c, t in zip(columns, _COLUMNS[kind].split(), strict=True))


def _unpack(kind: int, data: bytes) -> list[np.ndarray]:
    types = [np.dtype("<" + t) for t in _COLUMNS[kind].split()]
    n, at, out = len(data) // sum(t.itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * t.itemsize
    return out


def _pack_runs(group: np.ndarray, context: np.ndarray, at: np.ndarray, doc: np.ndarray) -> bytes:
    """Tokens by sorted groups, each of which is written once."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    runs = np.diff(first, append=len(group))
    head = np.array([len(first), len(group)], "<u4")
    return b"".join(x.tobytes() for x in (head, group[first].astype("<u8"), runs.astype("<u4"), at.astype("<u4"), context[first].astype("<u2"), doc.astype("<u2")))


def _unpack_runs(data: bytes) -> tuple[np.ndarray, ...]:
    runs, n = np.frombuffer(data, "<u4", 2).tolist()
    out, place = [], 8
    for kind, many in (("<u8", runs), ("<u4", runs), ("<u4", n), ("<u2", runs), ("<u2", n)):
        out.append(np.frombuffer(data, kind, many, place))
        place += out[-1].nbytes
    group, each, at, context, doc = out
    return np.repeat(group, each), np.repeat(context, each), at, doc


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return frame(rows, ["bucket", "kind", "block", "data"])


def _word_rows(hand):
    """The words that are not at hand, by buckets of their keys."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, keys, logs = hand.value, [], []

        def packed() -> pd.DataFrame:
            key, lp = np.concatenate(keys), np.concatenate(logs)
            order = np.argsort(key)
            order = order[known.find(key[order])[0] < 0]
            key, lp = key[order], lp[order]
            return _rows([(i, _WORDS, 0, _pack(_WORDS, (key[part], lp[part]))) for i, part in known.parts(key)])

        for batch in batches:
            keys.append(keys_of([bytes(w) for w in batch["word"]]))
            logs.append(batch["lp"].to_numpy(np.float64))
            if len(keys) > 400:
                yield packed()
                keys, logs = [], []
        if keys:
            yield packed()

    return rows


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Documents (id, text hash, held out, bytes) in blocks."""
    block, size = [], 0
    for batch in batches:
        for doc_id, tkey, held, text in zip(batch["doc_id"].astype("Int64"), batch["tkey"], batch["held"], batch["text"], strict=True):
            block.append((None if doc_id is pd.NA else int(doc_id), tkey, held, text.encode("utf-8", "surrogatepass").lower()))
            size += len(block[-1][3])
            if size > _BLOCK or len(block) == 30_000:
                yield block
                block, size = [], 0
    if block:
        yield block


def _token_rows(hand, rare: bool):
    """The tokens that no frequent pair explains, by buckets: of their words, if these are rare and not at hand, or of their groups.

    A group is a restaurant: a context or, of a frequent word, a class of the rare words after it.  A row of each block has its
    documents, with what is known of their scores; of rare tokens it is the tokens alone that are left.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = hand.value
        pair_logs, floor, wide = known.contexts.logs, math.log10(known.model.total + known.model.distinct + 1), DISHES + 1
        task = TaskContext.get().partitionId()
        for serial, docs in enumerate(_blocks(batches)):
            number = (task << 12 | serial << 1) + rare
            if serial >= 2048 or number >= 1 << 32:
                raise ValueError("too many texts in a partition, or too many partitions")
            held = np.array([h for _, _, h, _ in docs])
            n_tokens, n_known, base, score = (np.zeros(len(docs)) for _ in range(4))
            found = []
            for begin, texts in pieces_of([d[3] for d in docs]):
                words = stream_of(texts)
                at, dish = known.find(words.key)
                context = np.where(dish < CONTEXTS, dish, CONTEXTS + _endings()[words.last])
                doc = begin + np.cumsum(words.end)[:-1] - 1
                group, before, class_ = words.key[:-1], context[:-1], class_of(words.key[1:])
                often, at, dish, key = before < CONTEXTS, at[1:], dish[1:], words.key[1:]
                group = np.where(often, mixed(group + (class_.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)), group)
                mine = (at < 0) if rare else (at >= 0)
                outer = np.where(often, pair_logs[before * wide + dish] + np.where(dish == DISHES, known.known + known.classes[np.minimum(before, CONTEXTS - 1), class_], 0.0), 0.0)
                score += np.bincount(doc, np.where(mine, outer, 0.0), len(docs))
                if rare:
                    left = np.flatnonzero(mine)
                    spelled = np.zeros(len(left), np.float32)
                    new = np.flatnonzero(held[doc[left]])
                    spelled[new] = math.log10(known.model.backoff) + np.maximum(words.spelled(known.model.spelling, left[new] + 1), -280)
                    found.append((key[left], group[left], before[left], doc[left], spelled))
                else:
                    n_tokens += np.bincount(doc, minlength=len(docs))
                    n_known += np.bincount(doc, mine, len(docs))
                    base += np.bincount(doc, np.where(mine, known.counted[at] - floor, 0.0), len(docs))
                    left = np.flatnonzero(mine & ~(often & (dish < DISHES)))
                    found.append((group[left], before[left], at[left], doc[left]))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            columns[3] = columns[3] + _HELD * held[columns[3]]
            out = []
            for i, part in known.parts(columns[0]):
                here = [c[part] for c in columns]
                out.append((i, _RARE, number, _pack(_RARE, here)) if rare else (i, _TOKENS, number, _pack_runs(*here)))
            ids = [d[0] for d in docs]
            about = ([i or 0 for i in ids], [i is None for i in ids], [d[1] for d in docs], n_tokens, n_known, base, score)
            yield _rows([*out, (number % known.buckets, _DOCS, number, _pack(_DOCS, about))])

    return rows


def _columns(group: pd.DataFrame, kind: int) -> list[np.ndarray]:
    """Columns of all rows of a kind, and their block last."""
    here = group[group["kind"] == kind]
    parts = [_unpack(kind, d) for d in here["data"]] or [_unpack(kind, b"")]
    blocks = np.repeat(here["block"].to_numpy(np.int64), [len(p[0]) for p in parts]) if len(here) else np.zeros(0, np.int64)
    return [np.concatenate(c) for c in zip(*parts, strict=True)] + [blocks]


def _resolve(hand):
    def resolve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Rare tokens of a bucket of words, with their words' counts and probabilities, on to the buckets of their groups."""
        known = hand.value
        out = list(group[group["kind"] == _DOCS][["bucket", "kind", "block", "data"]].itertuples(index=False, name=None))
        words, logs, _ = _columns(group, _WORDS)
        order = np.argsort(words)
        words, logs = np.append(words[order], np.uint64(2**64 - 1)), np.append(logs[order], 0.0)
        word, to, context, doc, spelled, block = _columns(group, _RARE)
        if len(word):
            _, back = np.unique(word, return_inverse=True)
            count = np.bincount(back, (doc & _HELD) == 0)[back]
            new, often, class_ = count == 0, context < CONTEXTS, class_of(word)
            lp = logs[np.minimum(np.searchsorted(words, word), len(words) - 1)] - known.contexts.rare
            lp = np.where(new, known.unknown, lp)
            context = context.astype(np.int64)
            above = np.where(often, -known.shares[class_], known.contexts.logs[context * (DISHES + 1) + DISHES])
            # an unknown word has no class: what was said of the class is taken back, in a restaurant of no one
            above = np.where(often & new, -known.known - known.classes[np.minimum(context, CONTEXTS - 1), class_], above)
            to = np.where(often & new, mixed(word ^ np.uint64(FACTOR)), to)
            order = np.lexsort((doc, block, word, to))
            columns = [c[order] for c in (to, word, lp + above, count, block, doc)]
            out += [(i, _RESOLVED, 0, _pack(_RESOLVED, [c[part] for c in columns])) for i, part in known.parts(columns[0])]
            new = np.flatnonzero(new)
            more = spelled[new].astype(np.float64) - known.contexts.rare - known.unknown
            out += [(int(key[0]), _SPELLED, b, _pack(_SPELLED, c)) for b, c in _by_document(block[new], doc[new], more)]
        return _rows(out)

    return resolve


def _by_document(block: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Of each block its documents and their sums of values."""
    codes, back = np.unique(block.astype(np.int64) << 15 | (doc & (_HELD - 1)), return_inverse=True)
    sums = [np.bincount(back, v, len(codes)) for v in values]
    blocks, first = np.unique(codes >> 15, return_index=True)
    for b, at, end in zip(blocks.tolist(), first, np.append(first, len(codes))[1:], strict=True):
        yield b, [codes[at:end] & (_HELD - 1), *(s[at:end] for s in sums)]


def seat_pairs(group: np.ndarray, word: np.ndarray, base: np.ndarray, train: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """log10 of the probability of each token by the restaurant of its group, of which all tokens must be given.

    base: log10 of the probability of the word before the restaurant; train: the tokens that are customers.
    """
    order = np.lexsort((word, group))
    g, w = group[order], word[order]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    new = np.flatnonzero(new_group | np.concatenate([[True], w[1:] != w[:-1]]))
    of = np.repeat(np.arange(len(new)), np.diff(new, append=len(g)))
    customers = np.add.reduceat(train[order].astype(np.float64), new)
    where, above = (np.cumsum(new_group) - 1)[new], 10.0 ** base[order][new]
    discount = discount_of(np.count_nonzero(customers == 1), np.count_nonzero(customers == 2))
    tables, rooms = (customers > 0) * 1.0, int(where[-1]) + 1
    many = np.flatnonzero(customers > 1)
    held = np.bincount(where, tables, rooms)
    for at in range(0, len(many), _CHUNK):
        part = many[at : at + _CHUNK]
        room, back = np.unique(where[part], return_inverse=True)
        others = held[room] - np.bincount(back, tables[part])
        seated = gibbs(customers[part], above[part], back, discount, rng, others, reseats=PAIR_RESEATS)
        tables[part] = seated.mean
        held[room] = others + np.bincount(back, seated.mean)
    size = np.bincount(where, customers, rooms)
    logs = np.log10(predictive(customers, tables, size[where], held[where], discount, above))
    out = np.empty(len(g))
    out[order] = logs[of]
    return out


def _seat_and_score(hand):
    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The tokens of a bucket of groups, which has these whole: sums of their scores, by blocks of documents."""
        known = hand.value
        floor = math.log10(known.model.total + known.model.distinct + 1)
        out = list(rows[rows["kind"].isin([_DOCS, _SPELLED])][["bucket", "kind", "block", "data"]].itertuples(index=False, name=None))
        here = rows[rows["kind"] == _TOKENS]
        parts = [_unpack_runs(d) for d in here["data"]]
        group, word, base, count, block, doc, _ = _columns(rows, _RESOLVED)
        rare = len(group)
        base, block = base.astype(np.float64), block.astype(np.int64)
        if parts:
            to, context, at, number = (np.concatenate(c) for c in zip(*parts, strict=True))
            blocks = np.repeat(here["block"].to_numpy(np.int64), [len(p[0]) for p in parts])
            context, dish = context.astype(np.int64), known.dish[at]
            lp = np.where(dish == DISHES, known.logs[at] - known.contexts.rare, 0.0)
            lp += np.where(context < CONTEXTS, -known.shares[class_of(known.keys[at])], known.contexts.logs[context * (DISHES + 1) + dish])
            group, word, base = np.concatenate([group, to]), np.concatenate([word, at.astype(np.uint64)]), np.concatenate([base, lp])
            block, doc = np.concatenate([block, blocks]), np.concatenate([doc, number])
        if len(group):
            logs = seat_pairs(group, word, base, (doc & _HELD) == 0, np.random.default_rng([SEED, 5, int(key[0])]))
            counted = np.where(count > 0, 1, 0)
            sums = _by_document(block[:rare], doc[:rare], logs[:rare], np.log10(count + 1.0) - floor, counted)
            out += [(0, _RARE_SUMS, b, _pack(_RARE_SUMS, c)) for b, c in sums]
            out += [(0, _SUMS, b, _pack(_SUMS, c)) for b, c in _by_document(block[rare:], doc[rare:], logs[rare:])]
        return _rows(out)

    return score


_SCORES = "doc_id long, tkey long, whole boolean, n_tokens long, n_known long, base double, score double, more double"


def _add_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A row for each document of a block."""
    ids, none, tkey, n_tokens, n_known, base, score = (c.copy() for c in _columns(rows, _DOCS)[:-1])
    more = np.zeros(len(ids))
    rows = rows.sort_values(["kind", "bucket"])
    for kind, data in zip(rows["kind"], rows["data"], strict=True):
        if kind == _SPELLED:
            doc, value = _unpack(kind, data)
            more[doc] += value
        elif kind == _SUMS:
            doc, value = _unpack(kind, data)
            score[doc] += value
        elif kind == _RARE_SUMS:
            doc, value, counted, words = _unpack(kind, data)
            score[doc] += value
            base[doc] += counted
            n_known[doc] += words
    ids = pd.Series(ids, dtype="Int64").mask(none.astype(bool))
    return pd.DataFrame({"doc_id": ids, "tkey": tkey, "whole": int(key[0]) % 2 == 0, "n_tokens": n_tokens, "n_known": n_known, "base": base, "score": score, "more": more})


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, `most` of them at most: those above a step of frequency, eight steps to a doubling."""
    step = F.floor(F.log2("c") * 8).cast("int")
    left, least = most, 1 << 30
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 8 * 63 rows at most
        left -= row["n"]
        if left < 0:
            break
        least = row["step"]
    return words.where(step >= least)


def _at_hand(model: WordModel, contexts: ContextModel, words: DataFrame, unknown: float) -> AtHand:
    """unknown: log10 of the probability of an unknown word by the restaurant of words."""
    keys, c, lp = gathered(_frequent(words, max(AT_HAND, DISHES)), word="u8", c="f8", lp="f8")
    order = np.argsort(keys)
    keys = keys[order]
    # few may be at hand, but dishes always are
    ranked = keys_of(contexts.ranked)
    dish = np.full(len(keys), DISHES)
    dish[np.searchsorted(keys, ranked)] = np.arange(len(ranked))
    mass = np.zeros(CLASSES)
    for row in words.select("word", "lp").mapInPandas(_weigh_classes(ranked), "class int, p double").groupBy("class").agg(F.sum("p").alias("p")).collect():
        mass[row["class"]] = row["p"]
    shares = np.maximum(mass / 10.0**contexts.rare, 1e-300)
    share = min(1.0, 10.0 ** (unknown - contexts.rare))
    size = contexts.counts.sum(axis=1, keepdims=True)
    classes = (contexts.counts + STRENGTH * shares / shares.sum()) / (size + STRENGTH)
    end = np.zeros(1)  # a key that no word has, so that there is one
    return AtHand(
        np.append(keys, np.uint64(2**64 - 1)), np.append(np.log10(c + 1)[order], end), np.append(lp[order], end),
        np.append(dish, DISHES), contexts, np.log10(shares), unknown - contexts.rare, math.log10(max(1e-300, 1 - share)), np.log10(np.maximum(classes, 1e-300)), model,
        max(1, math.ceil(model.total / PAIRS)),
    )


def _weigh_classes(ranked: np.ndarray):
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass = np.zeros(CLASSES)
        for batch in batches:
            key = keys_of([bytes(w) for w in batch["word"]])
            mass += np.bincount(class_of(key), np.where(np.isin(key, ranked), 0.0, 10.0 ** batch["lp"].to_numpy(np.float64)), CLASSES)
        yield pd.DataFrame({"class": np.arange(CLASSES), "p": mass})

    return weigh


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 7 = 2; a row without an id counts by the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, spelled_score of every row.

    score is the model's log10 probability of the text as a sequence of known words and "an unknown word", the events
    of base_score, so that the two compare; spelled_score is that of the very text, which also asks which unknown word
    it is, by its spelling.  perplexity is that of score.  Rows equal in id and text score alike, however rows are
    dealt to tasks; texts of any length are read whole.
    The model learns from the rows that are not held out, repeated ones as often as they occur.  A null or
    empty text is its end token alone.  Without training rows all tokens are unknown, and the spelling is uniform.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    train = rows.where(~held_out(F.col("doc_id")))
    model, words = fit(train)
    unknown = math.log10(model.backoff * max(1e-12, 1 - (words.agg(F.sum("spelled").alias("s")).first()["s"] or 0.0)))
    hand = spark.sparkContext.broadcast(_at_hand(model, fit_contexts(train, words), words, unknown))
    texts = rows.withColumn("held", held_out(F.col("doc_id")))
    rare = texts.mapInPandas(_token_rows(hand, True), _ROWS).unionAll(words.select("word", "lp").mapInPandas(_word_rows(hand), _ROWS))
    rare = rare.groupBy("bucket").applyInPandas(_resolve(hand), _ROWS)
    tokens = texts.mapInPandas(_token_rows(hand, False), _ROWS).unionAll(rare)
    sums = tokens.groupBy("bucket").applyInPandas(_seat_and_score(hand), _ROWS)
    summed = sums.groupBy("block").applyInPandas(_add_up, _SCORES).groupBy("doc_id", "tkey").agg(
        F.count_if("whole").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum(F.col("score") + F.col("more")).alias("spelled_score"),
    )
    # repeated rows share a key: their sums are divided again, and each has its row
    one = {c: (F.col(c) / F.col("copies")) for c in ("n_tokens", "n_known", "base_score", "score", "spelled_score")}
    out = summed.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), one["n_tokens"].cast("long").alias("n_tokens"), one["n_known"].cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), one["base_score"].alias("base_score"), one["score"].alias("score"),
        F.pow(F.lit(10.0), -one["score"] / one["n_tokens"]).alias("perplexity"), one["spelled_score"].alias("spelled_score"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    )
    return out.drop("copy")
