"""Secret scan by a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match must contain.  The index
holds, for the trigrams of the rules' queries, posting lists of document ids in blocks of ids; lists of a
clause are intersected within a block, and rules run only over the documents that come out.  A rule without
mandatory trigrams runs over every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, keyed, materialize, text_key

#: Ids in one block of a posting list: lists hold at most so many distinct ids.
BLOCK = 1 << 13
#: Most strings and clauses that the analysis of a regex keeps before it settles for weaker ones.
MOST = 64


class Rule(NamedTuple):
    name: str
    pattern: str
    #: the group whose length counts, and its least length; shorter matches are dropped
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """Regex for the letters a-z of word in either case, in ASCII alone."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

# The base rules, then the formats of well-known credentials.
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
RULES = BASE + (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
    Rule("bearer", rf"{either_case('authorization')}:\x20*{either_case('bearer')}\x20+[A-Za-z0-9+/_.=-]{{16,}}"),
)

# --- trigram queries -----------------------------------------------------------------------------------
# A query is a set of clauses, any of which suffices; a clause is a set of trigrams, all of which are needed.
# {frozenset()} asks for nothing.  Letters A-Z are lower-cased, as the index holds them.

ANY = frozenset([frozenset()])


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST:
        return min(a, b, key=lambda q: (q == ANY, len(q)))
    return _least(frozenset(x | y for x in a for y in b))


def _least(query: frozenset) -> frozenset:
    """Without clauses that a weaker clause covers."""
    return frozenset(c for c in query if not any(o < c for o in query))


def _grams(strings: frozenset) -> frozenset:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


class _Part(NamedTuple):
    """exact: all strings the part can match, if these are few, else None; query: what any match holds."""

    exact: frozenset | None
    query: frozenset = ANY


def _letters(items) -> frozenset | None:
    out = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower() if value < 128 else chr(value))
        elif op is sre.RANGE and value[1] - value[0] < 10:
            out |= {chr(c).lower() if c < 128 else chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 6 else None


def _closed(part: _Part) -> frozenset:
    return part.query if part.exact is None else _both(part.query, _grams(part.exact))


def _sequence(nodes) -> _Part:
    """Runs of exact parts are joined into longer strings, whose trigrams reach over the parts' borders."""
    run, query, exact = frozenset([""]), ANY, True
    for node in nodes:
        part = _node(*node)
        if part.exact is not None and len(run) * len(part.exact) <= MOST:
            run = frozenset(a + b for a in run for b in part.exact)
            query = _both(query, part.query)
            continue
        query = _both(_both(query, _grams(run)), part.query)
        exact = False
        run = part.exact if part.exact is not None else frozenset([""])
    return _Part(run, query) if exact else _Part(None, _both(query, _grams(run)))


def _node(op, value) -> _Part:
    if op is sre.LITERAL:
        return _Part(_letters([(op, value)]))
    if op is sre.IN:
        return _Part(_letters(value))
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        if all(p.exact is not None for p in parts) and len(exact := frozenset().union(*(p.exact for p in parts))) <= MOST:
            return _Part(exact)
        return _Part(None, _least(frozenset().union(*map(_closed, parts))))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = value
        part = _sequence(inner)
        if (low, high) == (0, 1) and part.exact is not None:
            return _Part(part.exact | {""})
        if low == high == 1:
            return part
        if low and part.exact is not None and len(part.exact) ** min(low, 8) <= MOST:
            runs = frozenset([""])
            for _ in range(min(low, 8)):
                runs = frozenset(a + b for a in runs for b in part.exact)
            return _Part(runs if low == high <= 8 else None, _grams(runs))
        return _Part(None, _closed(part) if low else ANY)
    if op is sre.AT:
        return _Part(frozenset([""]))
    return _Part(None)


def trigram_query(pattern: str) -> frozenset:
    """Boolean query of a regex: a frozenset of clauses (any), each a frozenset of trigrams (all).

    The clause without trigrams stands for a regex that has no mandatory ones.
    """
    parsed = sre_parser.parse(pattern)
    query = _closed(_sequence(parsed))
    # the index holds ASCII trigrams; i, k and s match letters beyond ASCII where case is ignored
    odd = frozenset("iks") if re.compile(pattern).flags & re.IGNORECASE or "(?i" in pattern else frozenset()
    query = frozenset(frozenset(t for t in clause if t.isascii() and odd.isdisjoint(t)) for clause in query)
    return ANY if frozenset() in query else query


@cache
def queries_of(rules: tuple[Rule, ...]) -> dict[str, frozenset]:
    return {r.name: q for r in rules if (q := trigram_query(r.pattern)) != ANY}


# --- the index -------------------------------------------------------------------------------------------

_GRAMS = T.ArrayType(T.StringType())


def _grams_of(trigrams: list[str]):
    codes = {int.from_bytes(t.encode("ascii"), "big"): t for t in trigrams}

    @F.pandas_udf(_GRAMS)
    def grams(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = np.zeros(1 << 24, dtype=bool)
        wanted[list(codes)] = True
        for batch in texts:
            out = []
            for text in batch:
                data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8).astype(np.int32)
                code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
                out.append([codes[c] for c in np.unique(code[wanted[code]]).tolist()])
            yield pd.Series(out, dtype=object)

    return grams


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Posting lists (trigram, block, ids) of the trigrams in the rules' queries over all rows of docs.

    A block is the ids that agree but for their last 13 bits; a null id has the block null and the list [null].
    """
    trigrams = sorted({t for q in queries_of(rules).values() for clause in q for t in clause})
    rows = keyed(docs).select("doc_id", F.explode(_grams_of(trigrams)("text")).alias("trigram"))
    return rows.groupBy("trigram", F.expr(f"doc_id div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_set(F.coalesce("doc_id", F.lit(0)))).alias("ids"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): for each document whose postings satisfy a rule's query the names of these rules."""
    clauses = [(r, i, len(c), t) for r, q in queries_of(rules).items() for i, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    wanted = index.sparkSession.createDataFrame(clauses, "rule string, clause int, terms int, trigram string")
    lists = index.join(F.broadcast(wanted), "trigram").groupBy("rule", "clause", "terms", "block").agg(F.collect_list("ids").alias("lists"))
    met = lists.where(F.size("lists") == F.col("terms"))
    ids = met.select("rule", "block", F.explode(F.expr("aggregate(slice(lists, 2, size(lists)), lists[0], (a, x) -> array_intersect(a, x))")).alias("id"))
    ids = ids.select("rule", F.when(F.col("block").isNotNull(), F.col("id")).alias("doc_id"))
    return ids.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


# --- verification ----------------------------------------------------------------------------------------

_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])


def spans_of(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by the order of the rules."""
    out = []
    for order, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), order, rule.name, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _compiled(rule: Rule) -> re.Pattern:
    # a run of one class is as long at every start: the least length can be asked for at once
    single = rule.group == 0 and re.fullmatch(r"\[\^?\]?(?:[^\]\\]|\\.)*\]\+", rule.pattern, re.DOTALL)
    return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}" if single else rule.pattern)


def _finder(rules: tuple[Rule, ...]):
    """Of a text and the names of the indexed rules that may match it: its spans."""
    indexed, patterns = queries_of(rules), [(r, _compiled(r)) for r in rules]

    def find(text: str, names) -> list[tuple[str, int, int]]:
        names = set() if names is None else set(names)
        return spans_of(text, [(r, p) for r, p in patterns if r.name not in indexed or r.name in names])

    return find


def _verify(rules: tuple[Rule, ...]):
    @F.pandas_udf(T.ArrayType(_SPAN))
    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = _finder(rules)
        for texts, named in batches:
            yield pd.Series([[{"kind": k, "begin": a, "end": b} for k, a, b in find(*row)] for row in zip(texts, named, strict=True)], dtype=object)

    return verify


def _with_rules(docs: DataFrame, rules: tuple[Rule, ...], name: str) -> DataFrame:
    """docs with the column `name`: the indexed rules that may match a row's text.  Texts move once, to meet them."""
    id_ = fresh(docs, "_mr_id")
    found = materialize(candidates(build_index(docs, rules), rules), "candidates").select(F.col("doc_id").alias(id_), F.col("rules").alias(name))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[id_]), "left").drop(id_)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, spans (array of kind, begin, end in code points) of every row.

    Spans of a kind are leftmost and do not overlap; kinds may.  A null text is empty and has no spans.
    Candidates are found by doc_id: rows that share one (or have none) are each verified for themselves, repeated rows too.
    Texts of any length are read whole.  An empty table gives no rows; columns but doc_id and text are not read.
    """
    rows = _with_rules(keyed(docs).drop("tkey"), rules, "named")
    return rows.select("doc_id", "text", _verify(rules)("text", "named").alias("spans"))


def _cut(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    parts, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _redacted(rules: tuple[Rule, ...], mark: str):
    """The text without secrets, null if it has none: search and cut in one pass, so that a task needs one Python worker."""

    @F.pandas_udf(T.StringType())
    def redacted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = _finder(rules)
        for texts, named in batches:
            found = ((text, find(text, names)) for text, names in zip(texts, named, strict=True))
            yield pd.Series([_cut(text, spans, mark) if spans else None for text, spans in found], dtype=object)

    return redacted


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark (spans that overlap: one mark), and n_chars counted anew.

    Rows without secrets are as they were, null texts too; no row comes or goes.
    """
    named, cut = fresh(docs, "_mr_rules"), fresh(docs, "_mr_cut")
    rows = _with_rules(docs, rules, named)
    rows = rows.withColumn(cut, _redacted(rules, mark)(F.coalesce(F.col("text"), F.lit("")), F.col(named)))
    new = {"text": F.coalesce(cut, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length(cut).cast(docs.schema["n_chars"].dataType), "n_chars")
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
