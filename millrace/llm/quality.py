"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every text.  Expectation-maximisation over the
counts of all vote patterns (at most 3 to the number of labellers, however large the corpus) estimates each
labeller's accuracies and the share of good texts.  The posteriors then train a linear scorer on hashed words,
character shapes and text statistics, which scores every text, those too on which no labeller voted.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, keyed

#: Documents, about, that the linear scorer is fitted on: those of the smallest key hashes (its documented bound).
FIT_ROWS = 6_000
BITS = 16
ROUNDS = 200
THRESHOLD = 0.5

# --- labellers -------------------------------------------------------------------------------------------

_STOP = frozenset(  # fixed values: common words of the languages the corpus holds
    "the of and to in a is that for it as was with be by on he at an this his are not from or have had but you all were her she "
    "der die und das in den von zu mit ist des sich auf dem ein eine nicht im für es als auch an er so bei wie "
    "le la les de des et un une du en est que qui dans pour au par sur pas ce plus avec il elle son ne se "
    "el los las y en un una por con no para su al lo como más pero sus del se que o este".split()
)


class Statistics(NamedTuple):
    words: int
    letters: float  # share of letters and digits among non-space characters
    capitals: float  # share of ASCII capitals among letters
    marks: float  # symbols a word
    shouts: float  # exclamation marks a word
    distinct: float  # distinct words a word
    top: float  # share of the most frequent word
    repeats: float  # share of words that equal the word before
    common: float  # share of common function words
    length: float  # mean letters a word


def _members(characters: str) -> np.ndarray:
    return np.frombuffer(characters.encode("ascii"), dtype=np.uint8)


_CAPITALS, _SMALL = np.arange(65, 91), np.arange(97, 123)
_MARKS, _SPACES = _members("*#$%&|<>{}[]~^\\=+@_"), _members(" \t\n\r\x0b\x0c")


def statistics(text: str, words: list[str], counts: Counter[str]) -> Statistics:
    """Of a text, its words in lower case and their counts.  A character beyond ASCII counts as a letter."""
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    n = max(1, len(words))
    wide = int(octets[0xC0:].sum())
    capitals = int(octets[_CAPITALS].sum())
    letters = capitals + int(octets[_SMALL].sum()) + wide
    solid = int(octets[:128].sum() - octets[_SPACES].sum()) + wide
    return Statistics(
        len(words), (letters + int(octets[48:58].sum())) / max(1, solid), capitals / max(1, letters), int(octets[_MARKS].sum()) / n, int(octets[33]) / n, len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n, sum(map(_STOP.__contains__, words)) / n, letters / n,
    )


def _parts(text: str) -> tuple[list[str], Counter[str], Statistics]:
    words = text.lower().split()
    counts = Counter(words)
    return words, counts, statistics(text, words, counts)


#: Most vote bad or not at all: that a text is free of one fault says little for it.
LABELLERS = {
    "letters": lambda s: -1 if s.words and s.letters <= 0.75 else 0,
    "capitals": lambda s: -1 if s.capitals >= 0.5 else 0,
    "marks": lambda s: -1 if s.marks >= 0.3 else 0,
    "shouts": lambda s: -1 if s.shouts >= 0.3 else 0,
    "variety": lambda s: -1 if s.words >= 20 and s.distinct <= 0.15 else 0,
    "top_word": lambda s: -1 if s.words >= 20 and s.top >= 0.3 else 0,
    "repeats": lambda s: -1 if s.words >= 10 and s.repeats >= 0.3 else 0,
    "common": lambda s: 0 if s.words < 20 else 1 if s.common >= 0.12 else -1 if s.common <= 0.02 else 0,
    "substance": lambda s: -1 if not s.words else 1 if s.words >= 5 and s.distinct >= 0.3 else 0,
    "tidy": lambda s: 1 if s.letters >= 0.85 and s.capitals <= 0.15 and s.marks <= 0.05 and s.repeats <= 0.1 else 0,
}


def votes_of(s: Statistics) -> list[int]:
    return [f(s) for f in LABELLERS.values()]


# --- label model -----------------------------------------------------------------------------------------


class LabelModel(NamedTuple):
    prior: float
    #: P(vote | bad text) and P(vote | good text) for votes -1, 0, 1 of each labeller
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes."""
        rows = np.zeros((2, len(votes)))
        for k in range(self.table.shape[0]):
            rows += np.log(self.table[k][:, votes[:, k] + 1])
        odds = rows[1] - rows[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, begun at the majority of the votes.

    Smoothed by one vote each way.  No patterns: a model that knows nothing.
    """
    labellers = votes.shape[1]
    good = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    model = LabelModel(0.5, np.full((labellers, 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        table = np.array([[[1 + weight[c][votes[:, k] == v].sum() for v in (-1, 0, 1)] for c in (0, 1)] for k in range(labellers)])
        total = weight.sum(axis=1) + 1
        model = LabelModel(float(total[1] / total.sum()), table / table.sum(axis=2, keepdims=True))
        now = model.posterior(votes)
        if len(now) == 0 or np.abs(now - good).max() < 1e-9:
            break
        good = now
    return model


# --- linear scorer ---------------------------------------------------------------------------------------

_SHAPES = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "x"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "X"), **dict.fromkeys("0123456789", "9")})
_STEPS = {name: [zlib.crc32(f"{name} {i}".encode()) for i in range(21)] for name in Statistics._fields}
WORD_WEIGHT, STEP_WEIGHT = 0.2, 1.0


def _slots(names: Counter[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, (n.encode("utf-8", "surrogatepass") for n in names)), np.int64, len(names))


def features(text: str, counts: Counter[str], s: Statistics, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots and values: words, word shapes (together of unit length), and the statistics cut into steps."""
    shapes = Counter(text.translate(_SHAPES).split())
    values = np.concatenate([WORD_WEIGHT * np.fromiter(counts.values(), float, len(counts)), np.fromiter(shapes.values(), float, len(shapes))])
    values /= np.sqrt(values @ values) or 1.0
    steps = [
        _STEPS[name][min(20, int(value * 20) if name not in ("words", "length") else int(np.log2(1 + value)))]
        for name, value in zip(Statistics._fields, s, strict=True)
    ]
    slots = np.concatenate([_slots(counts), _slots(shapes) ^ 0x5BD1E995, np.array(steps)]) & ((1 << bits) - 1)
    return slots, np.concatenate([values, np.full(len(steps), STEP_WEIGHT)])


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        odds = float(self.weights[slots] @ values + self.bias)
        return 1 / (1 + np.exp(-max(-500.0, min(500.0, odds))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS, epochs: int = 150, rate: float = 2.0, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on soft labels by full-batch gradient steps (AdaGrad); the same rows in any order give the same fit."""
    weights, bias = np.zeros(1 << bits), 0.0
    if not rows:
        return Scorer(weights, bias)
    slots = np.concatenate([s for s, _ in rows])
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    seen = np.full(1 << bits, 1e-8)
    seen_bias = 1e-8
    for _ in range(epochs):
        odds = np.bincount(row, weights[slots] * values, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -500, 500))) - target
        slope = np.bincount(slots, values * error[row], 1 << bits) / len(rows) + ridge * weights
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen) * 0.1
        step = error.mean()
        seen_bias += step**2
        bias -= 0.1 * rate * step / seen_bias**0.5
    return Scorer(weights, bias)


# --- on Spark --------------------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.ByteType()))
def _votes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([votes_of(_parts(t)[2]) for t in batch], dtype=object)


def fit(docs: DataFrame) -> tuple[LabelModel, Scorer]:
    """The label model over all documents, and the scorer over FIT_ROWS of them.

    The driver gets one row for each vote pattern, and the features of FIT_ROWS documents.
    """
    rows = keyed(docs)
    patterns = rows.select(_votes("text").alias("votes")).groupBy("votes").agg(F.count("*").alias("n")).collect()
    votes = np.array([r["votes"] for r in patterns], dtype=np.int64).reshape(-1, len(LABELLERS))
    order = np.lexsort(votes.T) if len(votes) else []
    labels = fit_labels(votes[order], np.array([r["n"] for r in patterns], dtype=float)[order])

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                _, counts, s = _parts(text)
                slots, values = features(text, counts, s)
                out.append((slots.astype("<i4").tobytes(), values.astype("<f4").tobytes(), votes_of(s)))
            yield pd.DataFrame(out, columns=["slots", "values", "votes"])

    # a share of the hashes of (doc_id, text), each key once however often it is repeated: about FIT_ROWS at most
    share = min(1.0, FIT_ROWS / max(1, sum(r["n"] for r in patterns)))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", "tkey"), 11) < F.lit(int(share * 2**53)))
    sample = sample.dropDuplicates(["doc_id", "tkey"])
    fitted = sample.mapInPandas(featurize, "slots binary, values binary, votes array<tinyint>").toPandas()
    fitted = fitted.sort_values(["slots", "values"])
    pairs = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4")) for s, v in zip(fitted["slots"], fitted["values"], strict=True)]
    target = labels.posterior(np.array(fitted["votes"].tolist(), dtype=np.int64).reshape(-1, len(LABELLERS)))
    return labels, fit_scorer(pairs, target)


def _scored(docs: DataFrame, name: str) -> DataFrame:
    labels, scorer = fit(docs)
    shape = T.StructType([T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(shape)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            votes, scores = [], []
            for text in batch:
                _, counts, s = _parts(text)
                votes.append(votes_of(s))
                scores.append(scorer.score(*features(text, counts, s)))
            posterior = labels.posterior(np.array(votes, dtype=np.int64).reshape(-1, len(LABELLERS)))
            yield pd.DataFrame({"posterior": posterior, "score": np.array(scores, dtype=float)})

    return docs.withColumn(name, score(F.coalesce(docs["text"], F.lit(""))))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (the label model's P(good)), score (the scorer's), keep of every row.

    Null and empty texts are texts without words: no labeller votes for them, the scorer decides.
    Equal texts score alike; an empty table gives no rows.  Texts of any length are read whole; a score at the threshold is kept.
    """
    rows = _scored(keyed(docs).drop("tkey"), "scored")
    return rows.select("doc_id", "scored.posterior", "scored.score", (F.col("scored.score") >= THRESHOLD).alias("keep"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns."""
    name = fresh(docs, "_mr_scored")
    return _scored(docs, name).where(F.col(name)["score"] >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
