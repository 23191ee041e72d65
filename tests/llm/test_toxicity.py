import math
import re
import sys
import zlib

import numpy as np

from millrace.llm import toxicity as tx
from millrace.llm.queries import queries

LEXICON, MACHINE = tx.Lexicon(["zorgl"]), tx.grammar()


def marks(text):
    written, _ = MACHINE.run([LEXICON.read(w) for w in tx._WORD.findall(text.lower())])
    return [m for m in written if m in tx.MARKS]


def test_grammar_marks_clauses():
    assert marks("What an idiot") == ["I"]
    assert marks("You are an idiot") == ["A"]
    assert marks("idiot that you are") == ["I", "A"]
    assert marks("You are not an idiot") == ["d"]
    assert marks("She said the man was an idiot") == ["q"]
    assert marks("I will kill you") == ["M"] and marks("weeds: kill them not") == ["M"]
    assert marks("the frost may kill") == [] and marks("zorglath") == ["I"] and marks("a fine day") == []


def test_phrases():
    assert marks("you piece of trash") == ["A"] and marks("a piece of filth") == ["I"] and marks("take out the trash") == [] and marks("a piece of cake") == []
    assert marks("I will break your neck") == ["M"] and marks("break the neck") == [] and marks("a sore neck") == []
    assert marks("you will all bleed") == ["M"] and marks("wounds bleed") == [] and marks("they said you will suffer") == ["q"] and marks("you shall not perish") == ["d"]


def rewritten(words):
    """Marks and weight of a clause by rules over positions, without any machine."""
    c = [LEXICON.read(w) for w in words]
    c = ["I" if x == "j" and c[max(0, i - 2) : i] == ["p", "f"] else "o" if x in "pfj" else x for i, x in enumerate(c)]
    c = ["H" if x == "y" and c[max(0, i - 2) : i] == ["b", "T"] or x == "e" and "m" in c[max(0, i - 3) : i] else "o" if x in "byme" else x for i, x in enumerate(c)]
    c = ["d" if x in "IH" and "N" in c[max(0, i - 4) : i] else x for i, x in enumerate(c)]
    c = ["q" if x in "IHd" and "R" in c[:i] else x for i, x in enumerate(c)]
    out, kinds = [], {}
    for i, x in enumerate(c):
        # the last target or unaimed match at most four words back; what is aimed keeps its target near
        near = [j for j in kinds if i - j <= 4]
        back = kinds[near[-1]] if near else ""
        if x == "T":
            kinds[i], x = "T", {"I": "A", "H": "M"}.get(back, x)
        elif x in "IH":
            kinds[i] = "T" if back == "T" else x
            x = {"I": "A", "H": "M"}[x] if back == "T" else "I" if x == "I" else "o"
        out.append(x)
    return [x for x in out if x in tx.MARKS], sum(tx.WEIGHTS.get(x, 0) for x in out)


def brute_features(text, lexicon):
    total = most = 0.0
    seen = set()
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        found, weight = rewritten(re.findall(r"\w+(?:'\w+)?", clause))
        seen, total, most = seen | set(found), total + weight, max(most, weight)
    return [float(total > 0), math.log1p(total), most, *(float(m in seen) for m in tx.MARKS)]


SAID = "you idiot idiots they kill will not never said claimed piece of trash filth break your neck bleed zorglath a the fine wirst sterben".split()


def test_the_machine_against_rules_over_positions():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        words = [SAID[i] for i in rng.integers(0, len(SAID), rng.integers(1, 14))]
        text = "".join(w + str(rng.choice([" ", " ", " ", " ", ". ", ", "])) for w in words)
        assert np.allclose(tx.features(text, LEXICON, MACHINE), brute_features(text, LEXICON)), text


def test_query_against_rules_over_positions(spark, monkeypatch):
    """Every score of the query is the fitted curve over marks that rules alone find."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, weights = tx.fit(docs, labels)
    monkeypatch.setattr(sys.modules[__name__], "LEXICON", lexicon)
    got = {r.doc_id: r.score for r in queries()["op7_toxicity"](spark, sf).collect()}
    for d in docs.collect():
        odds = float(weights[0] + weights[1:] @ np.array(brute_features(d.text, lexicon)))
        assert abs(got[d.doc_id] - 1 / (1 + math.exp(-odds))) < 1e-9


def test_clauses_count_and_not_words_alone():
    x = {t: tx.features(t, LEXICON, MACHINE) for t in ("You are an idiot. Nice day.", "You are not an idiot.", "He said: they are. An idiot said.", "")}
    heavy = [v[2] for v in x.values()]
    assert heavy[0] > heavy[2] > heavy[1] > heavy[3] == 0


def test_composition_is_application_in_turn():
    a, b = tx.build(0, tx.CLASSES, tx._negation), None
    b = tx.build(0, tx._written(a), tx._report)
    both = tx.compose(a, b)
    rng = np.random.default_rng(0)
    for _ in range(200):
        seq = [tx.CLASSES[i] for i in rng.integers(0, 6, 12)]
        mid, v = a.run(seq)
        out, w = b.run(mid)
        assert both.run(seq) == (out, v + w)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries()["op7_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and (r.predicted == 1) == (r.score >= 0.5) for d, r in rows.items())
    out = [(rows[d].predicted, y) for d, y in labels.items() if rows[d].held_out]
    assert np.mean([p for p, y in out if y == 1]) > 0.9 and np.mean([p for p, y in out if y == 0]) < 0.01


def test_edge_rows(spark):
    docs = [(None, None), (1, ""), (2, "You are an idiot"), (2, "You are an idiot"), (3, "fine " * 30000)]
    df = spark.createDataFrame([(*d, "en", 0.0) for d in docs], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 1), (9, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        out = tx.score(df, known).collect()
        assert len(out) == 5 and [r.predicted for r in sorted(out, key=lambda r: str(r.doc_id))] == [0, 1, 1, 0, 0]
    assert tx.score(df.limit(0), labels).collect() == []
