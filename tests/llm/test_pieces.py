import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from millrace.llm import pieces
from millrace.llm.queries import queries

SF = "/root/testdata/sf0.001"
LIBRARY = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OWN = pieces.Segmenter()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def whole(text):
    chunks = OWN.chunks(text)
    return OWN.whole(OWN.segment(chunks))


def expected(text):
    ids = LIBRARY.encode(text)
    return ",".join(map(str, ids)), LIBRARY.decode(ids)


ODD = ["", " ", "  ", "a ", " a", "a  b", "▁", "a▁b", "a▁ b", "▁▁ ▁x", "a\x00b", "\n\nx", "\t x\r\n y", "　ﬁ Å", "😀 👩‍👩‍👧", "中文没有空格" * 50, "x" * 5000, "   " * 40, "<s> </s><unk> <0x41>", "é ▁▁"]


@pytest.mark.parametrize("text", ODD)
def test_chunks_give_the_library_s_ids_and_text(text):
    assert OWN.cuts
    assert whole(text) == expected(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab.\n<s>0x41"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert whole(text) == expected(text)


def test_query(spark):
    got = sorted(tuple(r) for r in queries()["op12_sentencepiece"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for d in docs:
        ids, text = expected(d.text)
        want.append((d.doc_id, len(LIBRARY.encode(d.text)), sha(ids), sha(text)))
    assert got == sorted(want)


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_edge_rows(spark, most):
    """Null ids, null and empty texts, repeated rows, columns of the new names; whether chunks are broadcast or not."""
    rows = [(1, t, "x", 7) for t in ODD] + [(None, None, "y", 8), (2, None, None, None), (3, "a b", "z", 9), (3, "a b", "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, s int")
    out = pieces.encode(df, most=most)
    assert out.columns == ["doc_id", "text", "decoded", "s", "ids", "_decoded"]
    got = sorted(((r.doc_id, r.text, r.decoded, r.ids, r._decoded) for r in out.collect()), key=repr)
    assert got == sorted([(i, t, x, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, x, _ in rows], key=repr)
    assert pieces.encode(df.limit(0), most=most).collect() == []
    assert pieces.encode(df.limit(0), most=most, digests=True).collect() == []


def test_the_table_counts_all_chunks(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a  b"), (3, None)], "doc_id long, text string")
    assert {r.chunk: r.n for r in pieces.chunk_table(df).collect()} == {"a": 3, "b": 1, "▁b": 1}
    known = pieces.frequent_chunks(pieces.chunk_table(df), most=1)
    assert set(known) == {"a"} and known["a"] == (str(LIBRARY.encode("a")[0]), " a")


def test_pieces_that_cross_markers_or_another_normaliser_get_whole_texts():
    other = pieces.Segmenter()
    other.cuts = False
    for text in ODD:
        assert other.whole(other.segment(other.chunks(text))) == expected(text)
