"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads words and writes their classes; its insults are seed words and stems learned from labelled documents.
Sequential transducers over the classes follow: one writes insults, single words or phrases (a piece of trash), one threats
(a verb of violence, break your neck, you will bleed), and others mark those that are negated, reported, or aimed at a target.
They are composed into one machine, whose arcs carry weights.  It runs over clauses, and what a clause matches, not which words a document
has, makes the features of the score: a logistic curve fitted to the same labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed

#: Labelled documents, those of the smallest id hashes, that the grammar is fitted on (its documented bound).
FIT_ROWS = 20_000
#: Stems are tried at these lengths, and as whole words.
STEM_LENGTHS = (4, 5, 6)
#: The 95 % lower bound of a stem's log odds, and its least share of the toxic documents and number of them.
LEAST_ODDS = 1.5
LEAST_SHARE, LEAST_DOCS = 0.01, 3
MOST_STEMS = 2_000

# Seed lexicon of the grammar.
INSULTS = "idiot idiots moron morons imbecile scum scumbag loser losers pathetic worthless disgusting dumbass trottel arschloch dummkopf connard salaud crétin imbécile cabrón gilipollas".split()
THREATS = "kill kills murder stab shoot strangle destroy hurt töten umbringen erschießen tuer égorger frapper matar golpear".split()
TARGETS = "you your yours you're yourself he she him her they them their those these people du dich dir ihr euch sie er tu toi vous votre il elle ils elles leur tú ti usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never none isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say reported reports claimed claims wrote quoted quote alleged sagte sagt berichtete schrieb zitierte dit disait rapporte écrit cité dijo dice informó escribió citó".split()

# Words that only phrases make an insult or a threat of.
PIECES = "piece pieces bunch sack lump stück haufen sack tas pedazo montón".split()
LINKS = "of de von".split()
JUNK = "trash garbage filth dirt crap dreck müll abschaum ordure ordures merde basura mierda".split()
BREAKS = "break smash crush brechen breche brich casser briser romper".split()
BODIES = "neck legs bones face skull genick knochen beine cou jambes cuello piernas huesos".split()
MODALS = "will shall gonna going must should wirst werdet werden soll vas va vais allez debe debes deben".split()
ENDS = "bleed suffer perish burn sterben bluten leiden mourir crever saigner morir sangrar sufrir".split()

CLASSES = INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "H", "T", "N", "R", "o"
#: words that the transducers of insults and threats read; what is left of them they write as other
WORDS = PIECE, LINK, RUBBISH, BREAK, BODY, MODAL, ENDING = "p", "f", "j", "b", "y", "m", "e"
#: classes without which a clause says nothing
HEAVY = frozenset((INSULT, THREAT, RUBBISH, BODY, ENDING))
#: written by the transducers: negated, reported, aimed insult, aimed threat
DENIED, QUOTED, AIMED, MENACE = "d", "q", "A", "M"
MARKS = (INSULT, AIMED, MENACE, DENIED, QUOTED)


class Transducer(NamedTuple):
    """Sequential: in each state one arc for each symbol, (written symbol, weight, next state)."""

    start: object
    arcs: dict

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        state, out, weight = self.start, [], 0.0
        for symbol in symbols:
            written, w, state = self.arcs[state, symbol]
            out.append(written)
            weight += w
        return out, weight


def build(start, symbols, step) -> Transducer:
    """The machine of the states that step(state, symbol) -> (written, weight, next) reaches from start."""
    arcs, front, known = {}, [start], {start}
    while front:
        state = front.pop()
        for symbol in symbols:
            arc = step(state, symbol)
            arcs[state, symbol] = arc
            if arc[2] not in known:
                known.add(arc[2])
                front.append(arc[2])
    return Transducer(start, arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of what a writes, in one machine; weights add."""

    def step(state, symbol):
        written, w, left = a.arcs[state[0], symbol]
        final, v, right = b.arcs[state[1], written]
        return final, w + v, (left, right)

    return build((a.start, b.start), sorted({s for _, s in a.arcs}), step)


def _written(machine: Transducer) -> list[str]:
    return sorted({arc[0] for arc in machine.arcs.values()})


#: Words over which a negation or a target reaches, and a modal verb.
REACH, SOON = 4, 3


def _insult(state: int, symbol: str):
    """Insults are words, or rubbish that someone is a piece of; state: how much of the phrase has been read."""
    if symbol == RUBBISH and state == 2:
        return INSULT, 0.0, 0
    read = 1 if symbol == PIECE else 2 if symbol == LINK and state == 1 else 0
    return (OTHER if symbol in (PIECE, LINK, RUBBISH) else symbol), 0.0, read


def _threat(state: tuple[int, int], symbol: str):
    """Threats are verbs of violence, a part of the body that is to be broken, or an end that someone is to come to.

    state: how much of "break your" has been read, and words left in which a modal verb is near.
    """
    read, near = state
    now = (1 if symbol == BREAK else 2 if symbol == TARGET and read == 1 else 0, SOON if symbol == MODAL else max(0, near - 1))
    if symbol == BODY and read == 2 or symbol == ENDING and near:
        return THREAT, 0.0, now
    return (OTHER if symbol in (BREAK, BODY, MODAL, ENDING) else symbol), 0.0, now


def _negation(state: int, symbol: str):
    if symbol == NEGATION:
        return symbol, 0.0, REACH
    if symbol in (INSULT, THREAT) and state:
        return DENIED, 0.0, state - 1
    return symbol, 0.0, max(0, state - 1)


def _report(state: int, symbol: str):
    """After a word of reporting, the rest of the clause is someone else's."""
    if symbol == REPORT:
        return symbol, 0.0, 1
    if symbol in (INSULT, THREAT, DENIED) and state:
        return QUOTED, 0.0, state
    return symbol, 0.0, state


def _target(state: tuple[int, str], symbol: str):
    """state: words left in reach of a target, or of an insult or threat that still looks for one."""
    left, waiting = state
    now = (left - 1, waiting) if left > 1 else (0, "")
    if symbol == TARGET:
        found = {INSULT: AIMED, THREAT: MENACE}.get(waiting if left else "", symbol)
        return found, 0.0, (REACH, TARGET)
    if symbol in (INSULT, THREAT):
        if left and waiting == TARGET:
            return (AIMED if symbol == INSULT else MENACE), 0.0, (REACH, TARGET)
        return (symbol if symbol == INSULT else OTHER), 0.0, (REACH, symbol)
    return symbol, 0.0, now


#: Fixed weights of what a clause says: an aimed insult more than a bare one, a denied or quoted one little.
WEIGHTS = {INSULT: 1.0, AIMED: 1.5, MENACE: 2.5, DENIED: 0.3, QUOTED: 0.4}


def grammar() -> Transducer:
    """Insults, threats, negation, reported speech, targets and the weights, composed in turn into one machine."""
    machine = build(0, CLASSES + WORDS, _insult)
    for start, step in (((0, 0), _threat), (0, _negation), (0, _report), ((0, ""), _target), (0, lambda state, symbol: (symbol, WEIGHTS.get(symbol, 0.0), state))):
        machine = compose(machine, build(start, _written(machine), step))
    return machine


_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"\w+(?:'\w+)?")


HEAD = 4


class Lexicon:
    """Words to classes.  stems: learned insults; one that ends in "$" is a whole word."""

    def __init__(self, stems: list[str]):
        phrases = ((PIECES, PIECE), (LINKS, LINK), (JUNK, RUBBISH), (BREAKS, BREAK), (BODIES, BODY), (MODALS, MODAL), (ENDS, ENDING))
        self.words = {w: c for ws, c in (*phrases, (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), (INSULTS, INSULT)) for w in ws}
        self.words |= {s[:-1]: INSULT for s in stems if s.endswith("$")}
        self.stems = frozenset(s for s in stems if not s.endswith("$"))
        #: first letters of all that can make a clause match
        self.heads = frozenset(w[:HEAD] for w in [*self.stems, *(w for w, c in self.words.items() if c in HEAVY)])

    def touches(self, low: str) -> bool:
        return not self.heads.isdisjoint([w[:HEAD] for w in set(_WORD.findall(low))])

    def read(self, word: str) -> str:
        found = self.words.get(word)
        if found in (None, TARGET, *WORDS) and any(word[:n] in self.stems for n in STEM_LENGTHS):
            return INSULT
        return found or OTHER


#: any match; log of the weights of all clauses; heaviest clause; whether each mark occurs
FEATURES = 3 + len(MARKS)


def features(text: str, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """What the clauses of a text match, a clause at a time; all zero if none matches."""
    low = text.lower()
    if not lexicon.touches(low):
        return [0.0] * FEATURES
    total = most = 0.0
    marks: Counter[str] = Counter()
    for clause in _CLAUSE.finditer(low):
        classes = [lexicon.read(w) for w in _WORD.findall(clause[0])]
        if not HEAVY.isdisjoint(classes):
            written, weight = machine.run(classes)
            marks.update(m for m in written if m in MARKS)
            total, most = total + weight, max(most, weight)
    return [float(total > 0), math.log1p(total), most, *(float(marks[m] > 0) for m in MARKS)]


# --- fitting ---------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a row without an id counts by the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _stems_of(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 3}
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {w + "$" for w in words}


_COUNTED = "stem string, toxic long, clean long"


def _count_stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic)].update(_stems_of(text))
        stems = sorted(counts[0].keys() | counts[1].keys())
        both = {"toxic": counts[1], "clean": counts[0]}
        yield pd.DataFrame({"stem": pd.Series(stems, dtype=object)} | {k: pd.Series([c[s] for s in stems], dtype="int64") for k, c in both.items()})


def learn_stems(labelled: DataFrame) -> list[str]:
    """Stems whose documents are toxic surely and far more often than others.

    labelled: text, toxic (0 or 1).  Of stems that begin alike the one that says it most exactly
    stays, or else the shortest.
    """
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    counts = labelled.mapInPandas(_count_stems, _COUNTED).groupBy("stem").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("n"))
    log = lambda a, b: F.log((F.col(a) + 0.5) / (F.lit(b) - F.col(a) + 0.5))
    picked = counts.where(F.col("p") >= max(LEAST_DOCS, int(bad * LEAST_SHARE)))
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    picked = picked.withColumn("odds", log("p", bad) - log("n", good) - 1.96 * spread)
    rows = picked.where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.log1p("p")), "stem").limit(MOST_STEMS).collect()
    docs = {r["stem"]: r["p"] for r in rows}
    # a longer stem that nearly all the documents of a shorter one have says it more exactly
    closer = {s[:n] for s, p in docs.items() for n in STEM_LENGTHS if n < len(s) and s[:n] in docs and p >= 0.9 * docs[s[:n]]}
    kept: set[str] = set()
    for stem in sorted(docs.keys() - closer, key=lambda s: (len(s.rstrip("$")), s)):
        if not any(stem[:n] in kept for n in STEM_LENGTHS):
            kept.add(stem)
    return sorted(kept)


#: The curve where there are no labels to fit: a match is toxic, its absence is not.
DEFAULT = np.array([-4.0, 4.0, 1.5, 0.5, 0.0, 0.5, 2.0, -1.0, -1.0])


def fit_curve(rows: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression drawn to DEFAULT, by Newton's method; first weight: the constant."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = DEFAULT.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + ridge * (w - DEFAULT)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_udf(lexicon: Lexicon):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def matched(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = grammar()
        for batch in texts:
            yield pd.Series([features(t, lexicon, machine) for t in batch], dtype=object)

    return matched


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and curve from the labelled documents that are not held out, FIT_ROWS of them at most.

    Labels that are null do not count; a document labelled more than once is toxic if any label says so.
    Of several texts under one labelled id the curve is fitted on that of the smallest hash.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)  # FIT_ROWS ids: bounded, so broadcast
    rows = keyed(docs)
    labelled = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["id"]).select("id", "tkey", "text", "toxic")
    lexicon = Lexicon(learn_stems(labelled))
    # one text for each labelled id, that of the smallest hash: FIT_ROWS rows at most, however often an id is repeated
    each = labelled.select("id", "toxic", F.struct("tkey", _feature_udf(lexicon)("text").alias("x")).alias("r"))
    matched = each.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("r")["x"].alias("x")).select("toxic", "x").toPandas()
    x = np.array(matched["x"].tolist(), dtype=float).reshape(-1, FEATURES)
    order = np.lexsort(x.T)
    return lexicon, fit_curve(x[order], matched["toxic"].to_numpy(float)[order])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; score: probability of the label 1, from the text alone.

    A null or empty text matches nothing and gets the score of such texts; equal texts score alike.  Texts of any length are
    read whole; repeated rows each have a row; an empty table gives no rows, and without labels the curve is the prior's.
    """
    lexicon, weights = fit(docs, labels)
    matched = keyed(docs).select("doc_id", _feature_udf(lexicon)("text").alias("x"))
    odds = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        odds = odds + F.col("x")[i] * float(w)
    scored = matched.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-odds))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
