import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import xxhash

from millrace.llm import substring_dedup as sd
from millrace.llm.queries import queries


def units(text):
    """Sentences and their pieces as word lists, found without the operator's spans."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n+", text):
        words = sd.words_of(sentence)
        cuts = [0]
        if len(words) >= sd.LONG_WORDS:
            hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
            for at in range(len(words) - sd.WINDOW + 1):
                window = hashes[at : at + sd.WINDOW]
                cuts.append(at + max(k for k, h in enumerate(window) if h == min(window)))
        cuts = sorted({*cuts, len(words)})
        out += [(words[a:b], s) for s in [len(out)] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [u for u, _ in out if u]


def spans_of(us):
    """(first unit, end unit) of the shortest runs of SPAN_WORDS words from and to each unit."""
    n, found = len(us), set()
    for i in range(n):
        for step in (1, -1):
            total, j = 0, i
            while 0 <= j < n and total < sd.SPAN_WORDS:
                total += len(us[j])
                j += step
            if total >= sd.SPAN_WORDS:
                found.add((i, j) if step == 1 else (j + 1, i + 1))
    return sorted(found)


def brute(rows):
    """The words left of each row: spans by their words, first in the order of (id, hash of the text, row)."""
    key = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42)
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, signed(key(rows[k][1] or "")), k))
    seen, out = set(), []
    for k in order:
        us = units(rows[k][1] or "")
        gone = set()
        for i, j in spans_of(us):
            words = tuple(w for u in us[i:j] for w in u)
            if words in seen:
                gone |= set(range(i, j))
            seen.add(words)
        out.append((str(rows[k][0]), [w for i, u in enumerate(us) if i not in gone for w in u]))
    return sorted(out)


def words_left(got):
    return sorted((r[0], sd.words_of(r[3])) for r in got)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, h int")
    return sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.kept_text) for r in sd.deduplicate(df).collect())


@settings(max_examples=300, deadline=None)
@given(st.text("aB .!?\n", max_size=80))
def test_sentences_cover_the_text(text):
    cut = sd.sentences(text)
    assert "".join(text[a:b] for a, b in cut) == text and all(a < b for a, b in cut)


def passage(rng, words, sentence):
    out = []
    for i in range(words):
        w = "".join(rng.choice("abcdefgh") for _ in range(6))
        out.append((w.capitalize() if i % sentence == 0 else w) + ("." if i % sentence == sentence - 1 or i == words - 1 else ""))
    return " ".join(out)


def test_passages_over_50_words_go_wherever_they_stand(spark):
    rng = random.Random(5)
    for sentence in (3, 9, 19, 26, 60):
        p = passage(rng, 55, sentence)
        rows = [(i, f"{passage(rng, 30, 7)} {passage(rng, 4, 9).lower()[:-1]} {p} {passage(rng, 5, 9).lower()} {passage(rng, 20, 6)}") for i in range(3)]
        out = {r[0]: r for r in run(spark, rows)}
        assert p in out["0"][3] and out["0"][2] == 0
        for i in ("1", "2"):
            # what stays are words that share a sentence with words before or after the passage
            left = [w for w in p.split() if w in out[i][3].split()]
            assert p not in out[i][3] and len(left) <= sd.LONG_WORDS


def test_odd_rows_match_brute_force(spark):
    rng = random.Random(7)
    p, q = passage(rng, 60, 8), passage(rng, 25, 5)
    rows = [(5, p), (3, f"{q} {p}"), (3, q), (3, q), (None, p), (None, p + q), (None, None), (7, ""), (8, f"{p} {q} {p}"), (9, "a b c d e f g " * 300), (9, "other " * 4000), (10, "Short. Text.")]
    assert words_left(run(spark, rows)) == brute(rows)
    assert run(spark, []) == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.kept_text) for r in queries()["op3_substrings"](spark, sf).collect())
    assert words_left(got) == brute(rows) and sum(r[2] for r in got) > 0


def test_passages_cut_at_any_word_go(spark):
    """Passages of 50 words and more out of text without marks, in one case or without spaces, against word matching."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for shape in (str.lower, str.upper, None):
        n, glue = (120, " ") if shape else (120, "")
        unit = (lambda: shape(word())) if shape else (lambda: chr(rng.randrange(0x4E00, 0x9F00)))
        rows, shared = [], []
        for k in range(12):
            p = [unit() for _ in range(rng.randrange(50, 80))]
            shared.append(p)
            for c in range(2):
                around = [unit() for _ in range(n)]
                at = rng.randrange(n)
                rows.append((2 * k + c, glue.join(around[:at] + p + around[at:])))
        out = {r[0]: r for r in run(spark, rows)}
        texts = dict(rows)
        for k, p in enumerate(shared):
            first, second = out[str(2 * k)], out[str(2 * k + 1)]
            assert first[2] == 0
            left = second[3].split() if shape else list(second[3])
            before = texts[2 * k + 1].split() if shape else list(texts[2 * k + 1])
            gone = len(before) - len(left)
            # only words of the passage go, and all but some at its ends
            assert len(p) - 4 * sd.WINDOW <= gone <= len(p)
            assert set(before) - set(left) <= set(p)


def test_a_whole_sentence_between_two_cut_ones_goes(spark):
    rng = random.Random(10)
    whole = passage(rng, 39, 60)
    p = f"{passage(rng, 6, 60).lower()} {whole} {passage(rng, 6, 60)[:-1]}"
    rows = [(i, f"{passage(rng, 12, 60)[:-1]} {p} {passage(rng, 9, 60).lower()}") for i in range(2)]
    out = {r[0]: r for r in run(spark, rows)}
    assert whole in out["0"][3] and not set(whole.split()) & set(out["1"][3].split())


def test_rows_of_one_id_without_one_and_equal_rows(spark):
    p = passage(random.Random(3), 96, 8)
    other = passage(random.Random(4), 40, 8)
    for ids in ((7, 7, 7), (None, None, None)):
        out = run(spark, [(i, t) for i, t in zip(ids, (p, p, f"{other} {p}"), strict=True)])
        assert sum(p in r[3] for r in out) == 1 and sum(other in r[3] for r in out) == 1
        assert sum(len(r[3].split()) for r in out) == 96 + 40


def test_sentences_are_sentences(spark):
    assert [r[1] for r in run(spark, [(1, "Der Hund und die Katze gehen in den Garten. Dann kommen sie wieder.\n\nNeue Zeile")])] == [3]


def test_spans_make_only_the_hashes_that_are_asked_for():
    for text in ("One two three. " * 30, "Ein Straße für ΑΣ. " * 30, "一二三四五六七八九十" * 8):
        cut = sd.Cut(text)
        both, one = cut.spans(), cut.spans(1)
        assert len(both) == 3 and len(one) == 2 and (one[0] == both[0]).all() and (one[1] == both[1]).all()
